"""The inverted index against plain scans; ranks and quantiles of large groups."""

from __future__ import annotations

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators.inverted import ChunkIndex
from tessera.operators.ranking import quantiles, ranked

SCHEMA = "doc_id long, chunk_index int, title string, text string, path string"


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["abab", "bababa", "license", "Licensed", "relicensing", "x_1", "data", "DATA2", "éta", "日本語の文", "本語", "a", "ab"]
    return [(rng.randrange(0, 500) if i else None, i, " ".join(rng.choices(words, k=rng.randrange(0, 3))), rng.choice([" ", "-", ", "]).join(rng.choices(words, k=rng.randrange(0, 12))), f"src{i % 7}/en") for i in range(n)]


@pytest.fixture(scope="module", params=[1, 2])
def built(spark, request, tmp_path_factory):
    rows = corpus(request.param)
    df = spark.createDataFrame(rows, SCHEMA)
    return rows, ChunkIndex.build(df, f"file://{tmp_path_factory.mktemp('index')}/{uuid.uuid4().hex}", ("title", "text", "path"), 4)


def plain(rows, term):
    return {(d, c, term): (t.lower().count(term), x.lower().count(term), p.count(term)) for d, c, t, x, p in rows if d is not None and term in f"{t}\n{x}\n{p}".lower()}


def test_terms_are_found_inside_words(spark, built):
    rows, index = built
    terms = ["license", "abab", "ab", "a", "bab", "x_1", "語の文", "本語", "é", "src3", "none", "licensed", "ata2"]
    got = {(r.doc_id, r.chunk_index, r.term): (r.title, r.text, r.path) for r in index.matches(spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {}
    for t in terms:
        want |= plain(rows, t)
    assert got == want


def test_bm25_of_unseen_queries_reads_no_text(spark, built):
    rows, index = built
    terms = [(1, "license"), (1, "data"), (2, "bab"), (2, "nowhere")]
    df = R.bm25(index, terms)
    kept = [r for r in rows if r[0] is not None]
    size = {(d, c): max(len(t) - 2, 0) + max(len(x) - 2, 0) for d, c, t, x, _ in kept}
    mean, want = sum(size.values()) / len(kept), {}
    for q, term in terms:
        tf = {(d, c): t.lower().count(term) + x.lower().count(term) for d, c, t, x, _ in kept}
        tf = {k: v for k, v in tf.items() if v}
        raw = math.log((len(kept) - len(tf) + 0.5) / (len(tf) + 0.5))
        for k, v in tf.items():
            part = (raw if raw > 0 else 1e-6) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * size[k] / mean))
            want[q, *k] = want.get((q, *k), 0) + part
    got = {(r.query_id, r.doc_id, r.chunk_index): r.bm25 for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    read = {p for p in df.inputFiles()}
    assert read and all(any(f"/{t}/" in p for t in ("stats", "postings", "grams")) for p in read)
    assert "text" not in index.stats.columns


def test_postings_are_gaps_with_their_largest_count(spark, built):
    _, index = built
    rows = index.postings.collect()
    assert all(g > 0 for r in rows for g in r.gaps[1:])
    assert all(r.most == max(max(r.n0), max(r.n1), max(r.n2)) and len(r.gaps) == len(r.n0) for r in rows)
    assert len({(r.token, r.block) for r in rows}) == len(rows)


def test_empty_corpus(spark, tmp_path):
    index = ChunkIndex.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/i", ("title", "text"))
    assert R.bm25(index, [(1, "license")]).collect() == []


def test_ranks_of_ties_and_one_large_group(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(5), rng.randrange(20), i) for i in range(3000)] + [(None, 5, -1), (None, 7, -2)]
    df = spark.createDataFrame(rows, "k int, score int, id int").repartition(7)
    got = {r.id: r["rank"] for r in ranked(df, "k", [F.col("score").desc(), F.col("id")]).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))


def test_quantiles_are_exact(spark):
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.8 else rng.randrange(2, 6), float(rng.randrange(40))) for _ in range(900)] + [(None, 3.0), (7, None), (8, 2.5)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {r.k: r for r in quantiles(df, "k", "v", {"half": 0.5, "most_of": 0.9}, {"near": 0.95}).collect()}
    plain = df.groupBy("k").agg(F.percentile("v", 0.5).alias("half"), F.percentile("v", 0.9).alias("most_of"), F.expr("percentile_disc(0.95) within group (order by v)").alias("near"), F.min("v").alias("least"), F.max("v").alias("most"))
    want = {r.k: r for r in plain.collect() if r.half is not None}
    assert got == want
    assert "percentile" not in quantiles(df, "k", "v", {"half": 0.5})._jdf.queryExecution().toString()
