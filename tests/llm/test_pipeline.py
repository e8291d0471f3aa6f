from __future__ import annotations

import duckdb  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.conftest import SF
from tests.llm.test_near_copies import exact_components
from tests.llm.test_packing import brute_pieces, check_places
from tessera.llm import quality, toxicity
from tessera.llm.common import table, written


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    columns = docs.columns
    one = written(C.without_toxic(spark, docs, SF), "t")
    bad = toxicity.score(docs, toxicity.train(docs, C.toxic_labels(spark, SF))).filter("toxic = 1").select("doc_id")
    assert one.columns == columns and one.count() == docs.count() - bad.count() and one.join(bad, "doc_id", "left_semi").count() == 0
    two = written(C.without_poor(spark, one, SF), "t")
    good = quality.score(one, quality.train(one, table(spark, SF, "labels"))).filter("predicted = 1")
    assert two.columns == columns and two.count() == good.count()
    three = written(C.one_of_each(spark, two, SF), "t")
    rows = [tuple(r) for r in two.select("doc_id", "text").collect()]
    strict, loose = (exact_components([t for _, t in rows], s) for s in (0.9, 0.65))
    kept = {r.doc_id for r in three.select("doc_id").collect()}
    assert three.columns == columns and len(set(loose)) <= len(kept) <= len(set(strict))
    assert {min(rows[i][0] for i, x in enumerate(loose) if x == g) for g in set(loose)} <= kept
    four = written(C.mixed(spark, three, SF), "t")
    assert four.columns == columns
    originals = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        whole = originals[r.doc_id]
        assert r.text == whole or whole.split()[: len(r.text.split())] == r.text.split()
        assert r.n_chars == len(r.text)
    five = C.packed(spark, four, SF).collect()
    assert sorted([tuple(r)[:5] for r in five], key=str) == brute_pieces([(r.doc_id, r.text) for r in four.collect()])
    check_places(five)


def test_run(spark):
    rows = C.run(spark, SF).collect()
    assert rows and check_places(rows) > 0


def test_nulls_repeats_and_long_texts(spark):
    """Rows with null and repeated ids go through all stages; only copies and rejected texts are lost."""
    clean = [r.text for r in table(spark, SF, "documents").filter("lang = 'en' and n_chars > 1500").orderBy("doc_id").limit(12).collect()]
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    turned = [" ".join(t.split()[::-1]) for t in clean]  # of the same words, and no copy of a row of the table
    odd = [(None, turned[0]), (None, turned[1]), (7, clean[2]), (7, clean[3]), (None, None), (8, ""), (9, "x" * 10_000_000), (10, " ".join(clean) * 5), (None, turned[4]), (None, turned[4])]
    extra = spark.createDataFrame([(i, t, None if n % 2 else "en", "src1" if n % 3 else None, 0) for n, (i, t) in enumerate(odd)], docs.schema)
    more = docs.unionByName(extra).withColumns({"_kn": F.lit(1), "row": F.lit("r"), "number": F.lit(2), "hash": F.lit(3), "toxic": F.lit(0)})
    for _, stage in C.STAGES[:-1]:
        more = written(stage(spark, more, SF), "t")
    assert more.columns == [*docs.columns, "_kn", "row", "number", "hash", "toxic"] and more.count() > 0
    rows = C.packed(spark, more, SF).collect()
    assert check_places(rows) > 0 and {r.doc_id for r in rows} >= {None}


def test_extra_columns_and_empty_input(spark):
    docs = table(spark, SF, "documents").withColumn("epoch", F.lit("x")).withColumn("fp", F.lit(1))
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert C.mixed(spark, docs, SF).columns == docs.columns
