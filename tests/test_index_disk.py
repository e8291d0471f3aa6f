"""What building and asking the index shuffles: texts once, neither their words nor postings nor n-grams."""

from __future__ import annotations

import random
import uuid

import pytest

from tessera.operators import inverted
from tessera.operators.inverted import ChunkIndex

DOCS, WORDS = 400, 300


def _stages(spark):
    sc, jvm, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm, spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty(20000)
    found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(n) for n in range(found.size()))}


def shuffled(spark, run):
    """What ``run`` gives, and the records that it shuffled."""
    before = _stages(spark)
    out = run()
    return out, sum(n for k, n in _stages(spark).items() if k not in before)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{n}" for n in range(500)]
    rows = [(i, i % 3, f"title {i}", " ".join(rng.choices(words, k=WORDS)) + (" Zebrafish zebra" if i % 150 == 7 else "")) for i in range(DOCS)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, title string, text string").repartition(8)
    index, records = shuffled(spark, lambda: ChunkIndex.build(df, f"file://{tmp_path_factory.mktemp('index')}/{uuid.uuid4().hex}", ("title", "text"), 4))
    return rows, index, records


def test_words_are_counted_where_their_document_is(corpus):
    _, _, records = corpus
    assert DOCS <= records < DOCS * WORDS / 10


@pytest.fixture
def no_small_tables(spark):
    """As with tables that the planner takes for large."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_terms_are_sent_to_the_words_that_hold_them(spark, corpus, no_small_tables):
    rows, index, _ = corpus
    held = index.holders(spark.createDataFrame([("zebra",), ("ebrafis",)], "term string"))
    got, records = shuffled(spark, lambda: {(r.term, r.token, r.times) for r in held.collect()})
    assert got == {("zebra", "zebra", 1), ("zebra", "zebrafish", 1), ("ebrafis", "zebrafish", 1)}
    assert records < 200


@pytest.mark.parametrize("most", [500_000, 100, 3])
def test_postings_meet_many_words_in_rounds(spark, corpus, tmp_path, monkeypatch, no_small_tables, most):
    """However many words hold the terms, they are sent to the postings; both kinds of rounds give all matches."""
    rows, index, _ = corpus
    terms = ["zebra", "ba", "title", "99"] if most > 3 else ["zebra", "ba", "ge"]
    index.holders(spark.createDataFrame([(t,) for t in terms], "term string")).write.parquet(f"{tmp_path}/held")
    held = spark.read.parquet(f"{tmp_path}/held")
    monkeypatch.setattr(inverted, "HELD", most)
    got, records = shuffled(spark, lambda: {(r.term, r.doc_id, r.chunk_index): (r.title, r.text) for r in index.matches(None, held).collect()})
    want = {(t, d, c): (x.lower().count(t), y.lower().count(t)) for t in terms for d, c, x, y in rows if t in f"{x}\n{y}".lower()}
    assert got == want
    if most == 3:
        assert held.count() > most * index.buckets  # buckets are cut, too
    words = sum(x + y for x, y in got.values())
    assert records <= 2 * words
