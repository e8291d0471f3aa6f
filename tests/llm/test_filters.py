"""URL filter, mixing, toxicity, quality."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tessera.llm import mixing, quality, queries, toxicity, urls


def test_url_rules(spark):
    rows = [
        (1, "https://example.net/en/1?x"), (2, "http://EXAMPLE.net/de/"), (3, "x://a.org/fr/"), (4, "http://example.com/de/1"), (5, None), (6, "no scheme"), (7, "http://a.net"), (8, "http://b.org/q#f"),
        (9, "http://b.org/q/"), (9, "http://b.org/q/"), (None, "http://notexample.com/de/"), (10, "http://sub.example.com/de/?a=://z"), (11, "http://"),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, rule string, block string")
    listed = spark.createDataFrame([("b.org/q",), (None,), ("b.org/q",)], "url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, listed).collect()}
    assert got == {
        (1, "example.net", "/en/1", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"), (3, "a.org", "/fr/", "org/fr/", "allow"), (4, "example.com", "/de/1", "example.com/de/", "block"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "a.net", "", None, "allow"), (8, "b.org", "/q", None, "block"), (9, "b.org", "/q/", None, "block"),
        (None, "notexample.com", "/de/", None, "allow"), (10, "sub.example.com", "/de/", "example.com/de/", "block"), (11, "", "", None, "allow"),
    }
    assert urls.filter_urls(pages, listed).count() == len(rows)


def test_url_filter_without_list_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://b.org/q")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert [r.verdict for r in urls.filter_urls(pages, none).collect()] == ["allow"]
    assert urls.filter_urls(pages.limit(0), none).collect() == []


def test_a_full_bloom_filter_stays_exact(spark):
    """One block for everything: the filter passes all, the join decides."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    listed = spark.range(0, 300, 2).select(F.concat(F.lit("h.org/"), "id").alias("url"))
    got = urls.filter_urls(pages, listed, blocks=1).filter("verdict = 'block'")
    assert {r.page_id for r in got.collect()} == set(range(0, 300, 2))


def test_filter_grows_with_the_list(spark):
    assert [urls.blocks_for(n) for n in (0, 1, 16, 17, 1000, 10**6, 10**12)] == [1, 1, 1, 2, 64, 1 << 16, urls.MAX_BLOCKS]
    listed = spark.range(5000).select(F.concat(F.lit("h.org/"), "id").alias("url"))
    bloom = urls.bloom_filter(listed, "url", urls.blocks_for(5000))
    set_bits = bloom.select(sum(F.bit_count(f"w{i}") for i in range(urls.WORDS)).alias("n")).agg(F.avg("n")).first()[0]
    assert 50 < set_bits < 140


def _naive_share(children, budget):
    """Water filling by repetition: children (name, held, weight)."""
    left, open_, out = budget, dict((c[0], c[1:]) for c in children), {}
    while True:
        total = sum(w for _, w in open_.values())
        full = [n for n, (h, w) in open_.items() if h * total <= left * w]
        if not full:
            return out, left, open_
        n = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        out[n] = open_[n][0]
        left -= open_.pop(n)[0]


@pytest.mark.parametrize("budget", [0, 1, 17, 100, 159, 160])
def test_water_filling(spark, budget):
    rows = [("a", 10, 4), ("b", 100, 4), ("c", 20, 1), ("d", 30, 2)]
    df = spark.createDataFrame([("p", *r, budget) for r in rows], "parent string, child string, held long, weight long, budget long")
    got = {r.child: r.share for r in mixing.allot(df, ["parent"], "child").collect()}
    full, left, open_ = _naive_share(rows, budget)
    assert sum(got.values()) == min(budget, 160)
    assert all(got[n] == s for n, s in full.items())
    total = sum(w for _, w in open_.values())
    assert all(abs(got[n] - left * w / total) < 1 and got[n] <= h for n, (h, w) in open_.items())


def test_mixing_edges(spark):
    docs = [(1, "a b c", "en", "s1", "d0"), (2, None, "en", "s1", "d0"), (3, "", None, None, "d1"), (4, "x y " * 50, None, "s2", "d1"), (5, "q", "en", "s1", "d0"), (5, "q", "en", "s1", "d0"), (None, "n n", "de", "s3", "d0")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, domain string")
    one = {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}
    got = mixing.mix(df, one, 50, 3).collect()
    assert sum(r.taken for r in got) == 107 * 50 // 100
    assert {r.doc_id for r in got} <= {1, 4, 5, None}
    for r in got:
        assert 0 < r.taken <= r.tokens and r.epoch <= 3
    assert mixing.mix(df.limit(0), one).collect() == []
    clash = df.withColumns({"epoch": F.lit("x"), "number": F.lit("y"), "row": F.lit(1), "_kn": F.lit(2), "words": F.lit(3)})
    whole = mixing.mixed_texts(clash, F.lit("d0"), one, 300, 3)
    assert sorted(str(r.doc_id) for r in whole.collect()) == sorted(3 * ["1", "4", "5", "5", "None"])
    assert whole.columns == clash.columns


def test_budgets_end_inside_a_range_of_ranges(spark):
    """Many documents of one leaf: what is taken is the prefix of the whole order, sorted in one piece."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), *(F.lit("x").alias(c) for c in mixing.LEVELS))
    one = {c: F.lit(1) for c in mixing.LEVELS}
    got = mixing.mix(df, one, 37, 1).collect()
    order = sorted(range(20_000), key=lambda i: hashlib.md5(f"{mixing.SEED}:0:{i}".encode()).hexdigest())
    assert {r.doc_id for r in got} == set(order[: 20_000 * 37 // 100]) and sum(r.taken for r in got) == 60_000 * 37 // 100


def test_null_ids_keep_their_own_texts(spark):
    df = spark.createDataFrame([(None, f"t{i} words here", "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    one = {c: F.lit(1) for c in mixing.LEVELS}
    whole = mixing.mixed_texts(df, F.lit("d"), one, 200, 2)
    assert sorted(r.text for r in whole.collect()) == sorted(2 * [f"t{i} words here" for i in range(50)])


def test_mixing_matches_sql(spark):
    got = queries.op3_mixing(spark, SF)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op3_mixing"])
    rows = sorted([tuple(r[c] for c in want.columns) for r in got.collect()], key=str)
    assert rows == sorted(want.fetchall(), key=str)
    assert rows


CLEAN = "the quick brown fox goes over {} hills and {} rivers"


def _toxic_tables(spark):
    docs = [(i, CLEAN.format(i, i * 7) + (" you blargh moronic" if i % 4 == 0 else "")) for i in range(200)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(150)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, grade int")


def test_toxicity_learns_and_scores(spark):
    docs, labels = _toxic_tables(spark)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "blargh"), (None, "BLARGH, moronic!"), (903, "ok " * 200_000)], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs.unionByName(odd), model).collect()}
    assert all(got[i].toxic == int(i % 4 == 0) for i in range(200))
    assert got[900].toxic == got[901].toxic == got[903].toxic == 0 and got[None].toxic == 1
    assert got[4].severity > got[5].severity
    kept = toxicity.drop_toxic(docs.withColumn("toxic", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "toxic"] and {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 4}


def test_ordinal_grades_are_ordered():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = [sorted({1000 + int(x) for x in rng.integers(0, 50, 5)} | set(range(int(g)))) for g in grades]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = toxicity.fit(grades, offsets, np.concatenate(rows))
    place = {int(f): i for i, f in enumerate(model.features)}
    act = np.array([sum(model.weights[place[f]] for f in r if f in place) for r in rows])
    means = [model.probabilities(act)[grades == g].sum(1).mean() for g in range(3)]
    assert means[0] < means[1] < means[2] and model.thresholds[0] < model.thresholds[1]


def test_fit_is_as_good_as_a_plain_optimiser():
    """The penalised likelihood, written out row by row and minimised one parameter at a time, is not below the fit's."""
    rng = np.random.default_rng(2)
    x = (rng.random((160, 3)) < 0.4).astype(float)
    latent = x @ np.array([1.5, -1.0, 0.4]) + rng.logistic(size=160)
    grades = (latent > 0.3).astype(int) + (latent > 1.6)
    rows = [np.flatnonzero(r) for r in x]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = toxicity.fit(grades, offsets, np.concatenate(rows), steps=3000, ridge=0.01)
    sizes = {True: (grades > 0).sum(), False: (grades == 0).sum()}

    def loss(p):
        theta = [-np.inf, p[3], p[3] + np.exp(p[4]), np.inf]
        total = 0.005 * (p[:3] ** 2).sum()
        for r, g in zip(x, grades):
            below = lambda t: 1 / (1 + np.exp(-(t - r @ p[:3])))
            total -= 0.5 / sizes[bool(g > 0)] * np.log(below(theta[g + 1]) - below(theta[g]))
        return total

    p = np.array([0.0, 0.0, 0.0, 0.0, 0.0])
    for step in (0.5, 0.1, 0.02, 0.004):
        moved = True
        while moved:
            moved = False
            for i in range(5):
                for way in (step, -step):
                    q = p.copy()
                    q[i] += way
                    if loss(q) < loss(p) - 1e-12:
                        p, moved = q, True
    mine = np.append(model.weights, [model.thresholds[0], np.log(np.diff(model.thresholds)[0])])
    assert loss(mine) <= loss(p) + 1e-4 and np.abs(mine - p).max() < 0.1


def test_features_speak_either_way_and_grades_come_from_the_other_half(spark):
    docs = [(i, ("vile " if i % 4 == 0 else "kind " if i % 3 else "") + f"words {i} and more") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, grade int"))
    assert model.weights.min() < 0 < model.weights.max()
    grades = np.array([0, 1, 0, 1, 0, 1, 0, 1] * 10)
    rows = [[1, 10 + (i // 2) % 3] if g else [2] for i, g in enumerate(grades)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = toxicity.cross_grades(grades, offsets, np.concatenate(rows))
    assert (got[grades == 0] == 0).all() and set(got[grades == 1]) <= {1, 2}
    changed = toxicity.cross_grades(np.where(np.arange(80) == 1, 0, grades), offsets, np.concatenate(rows))
    assert changed[1] == 0  # a row's own label and grade go no further than its half
    assert (changed[(grades == 1) & (np.arange(80) % 2 == 1)][1:] > 0).all()


def test_repeated_labelled_ids_count_once(spark):
    docs, labels = _toxic_tables(spark)
    again = docs.unionByName(spark.createDataFrame([(4, "zz other text")] * 3000 + [(5, None)] * 50, "doc_id long, text string"))
    model = toxicity.train(again, labels)
    assert len(model.features) and {r.toxic for r in toxicity.score(spark.createDataFrame([(1, "blargh moronic")], "doc_id long, text string"), model).collect()} == {1}
    good, marks = _quality_tables(spark)
    model = quality.train(good.unionByName(spark.createDataFrame([(7, "x")] * 3000, "doc_id long, text string")), marks)
    assert len(model.labels) == len({i for i in range(300) if zlib.crc32(str(i).encode()) % 5})


def test_toxicity_without_labels(spark):
    docs, labels = _toxic_tables(spark)
    for part in (labels.limit(0), labels.filter("grade = 0")):
        assert {r.toxic for r in toxicity.score(docs, toxicity.train(docs, part)).collect()} == {0}
    assert {r.toxic for r in toxicity.score(docs, toxicity.train(docs, labels.filter("grade = 1"))).collect()} == {1}
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_held_out(spark):
    """Trained on four fifths of the labels of a larger table, checked on the rest."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), queries.toxic_labels(spark, sf)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels.filter(~held))
    truth = labels.select("doc_id", F.col("grade").alias("grade_label"))
    got = toxicity.score(docs.join(labels, "doc_id", "left_semi"), model).join(truth, "doc_id").filter(held)
    n = {(r.grade_label, r.toxic): r["count"] for r in got.groupBy("grade_label", "toxic").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]


def _quality_tables(spark):
    docs = []
    for i in range(300):
        good = i % 3 != 0
        words = " ".join(f"Word{i} flows on past {j} hills" for j in range(12))
        docs.append((i, words + "." if good else " ".join("BUY!! NOW!!" for _ in range(40))))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")


def test_quality_held_out(spark):
    docs, labels = _quality_tables(spark)
    model = quality.train(docs, labels)
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))
    extra = spark.createDataFrame([(900, None), (901, ""), (None, "Word1 flows on."), (902, "BUY!! " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs.unionByName(extra), model).collect()}
    assert all(got[i].predicted == int(i % 3 != 0) for i in range(300))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[902].predicted == 0
    kept = quality.drop_poor(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 200


def test_quality_against_brute_force(spark):
    docs, labels = _quality_tables(spark)
    model = quality.train(docs, labels)
    cache: dict = {}
    counts = np.stack([quality.term_counts(r.text.encode(), cache) for r in docs.limit(40).collect()])
    mine = model.score(counts)
    for row, got in zip(model.embed(counts), mine):
        cos = np.maximum(model.vectors @ row, 0)
        near = np.argsort(-cos, kind="stable")[: model.k]
        w = cos[near].astype(float) ** model.sharpness
        cut = np.sort(cos)[-model.k]
        if (cos == cut).sum() == 1 or len({model.labels[i] for i in np.nonzero(cos == cut)[0]}) == 1:
            assert got == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=1e-5)


def test_quality_without_labels(spark):
    docs, labels = _quality_tables(spark)
    model = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = _quality_tables(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score(docs, quality.train(docs, x)).collect())) for x in (labels, flipped))
    assert a == b


def test_order_key_is_md5(spark):
    got = spark.range(3).select(mixing.order_key(F.col("id"), F.lit(2), 9).alias("k")).collect()
    assert [r.k for r in got] == [hashlib.md5(f"9:2:{i}".encode()).hexdigest() for i in range(3)]
