"""Near copies: wide fingerprints, keys, links and the rows kept, against exact similarity of 5-word shingles."""

from __future__ import annotations

import numpy as np
import pytest

from tests.conftest import SF
from tessera.llm import near_copies as N


def jaccard(a, b):
    x, y = (set(N.shingle_hashes(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def exact_components(texts, similarity):
    """Smallest position reached over pairs of at least ``similarity``, all pairs compared."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [set(N.shingle_hashes((t or "").encode()).tolist()) for t in texts]
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and (x == y or len(x & y) >= similarity * len(x | y)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_bits_follow_similarity():
    rng = np.random.default_rng(0)
    assert N.differing_bits(1.0) == 0 and 70 < N.differing_bits(0.8) < 80
    for edits in (2, 6, 12):
        got, want = [], []
        for _ in range(40):
            words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
            a, b = " ".join(words), edited(rng, words, edits)
            x, y = N.wide_fingerprint(a.encode()), N.wide_fingerprint(b.encode())
            got.append(np.unpackbits((x ^ y).view(np.uint8)).sum()), want.append(N.differing_bits(jaccard(a, b)))
        assert abs(np.mean(got) - np.mean(want)) < 6


@pytest.mark.parametrize("similarity, least", [(0.8, 0.96), (0.85, 0.98), (0.9, 0.99), (0.95, 0.99)])
def test_share_of_pairs_that_share_a_key(similarity, least):
    rng = np.random.default_rng(3)
    flip = N.differing_bits(similarity) / 512
    one, two = (rng.integers(0, 1 << 63, 2000).astype(np.uint64) for _ in range(2))
    wrong = [(rng.random((2000, 64)) < flip) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)) for _ in range(2)]
    lows = rng.integers(0, 1 << 63, (2000, len(N.SEGMENTS))).astype(np.uint64)
    moved = np.where(rng.random(lows.shape) < similarity, lows, lows + np.uint64(1))
    rows, keys = N.segment_keys(one, two, lows)
    rows2, keys2 = N.segment_keys(one ^ wrong[0].astype(np.uint64), two ^ wrong[1].astype(np.uint64), moved)
    assert len(keys) < 60 * 2000
    mine = set(zip(rows.tolist(), keys.tolist()))
    assert len({r for r, k in zip(rows2.tolist(), keys2.tolist()) if (r, k) in mine}) >= least * 2000


def test_texts_share_smallest_hashes_as_often_as_they_are_alike():
    rng = np.random.default_rng(9)
    same, alike = [], []
    for _ in range(100):
        words = [f"w{i}" for i in rng.integers(0, 5000, 200)]
        a, b = " ".join(words), edited(rng, words, 6)
        same.append(N.fingerprint_and_least(a.encode())[1] == N.fingerprint_and_least(b.encode())[1]), alike.append(jaccard(a, b))
    assert abs(np.mean(same) - np.mean(alike)) < 0.05
    assert (N.fingerprint_and_least(None)[1] == N.fingerprint_and_least(b" \n")[1]).all()


def _groups_of_copies(rng):
    texts = []
    for g in range(25):
        words = [f"g{g}w{i}" for i in rng.integers(0, 3000, int(rng.integers(60, 300)))]
        texts.append(" ".join(words))
        for edits in (1, 1, 2):
            texts.append(edited(rng, words, edits))
    return texts + [" ".join(f"s{i}x{j}" for j in range(40)) for i in range(60)]


@pytest.mark.parametrize("max_bucket", [64, 2])
def test_copies_are_found_and_others_left_alone(spark, max_bucket):
    """With a bucket bound of 2 every shared key goes the way of crowded ones."""
    texts = _groups_of_copies(np.random.default_rng(1))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (None, texts[0]), (None, "nobody else has this text"), (903, "One two"), (904, "oNE  two"), (905, "word " * 50_000), (906, "x" * 500_000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, f0 int, root string")
    got = {r.doc_id: r.component_id for r in N.near_copies(df, max_bucket=max_bucket).collect() if r.doc_id is not None}
    strict, loose = exact_components(texts, 0.87), exact_components(texts, 0.7)
    for i in range(len(texts)):
        assert got[i] == got[strict[i]] and loose[got[i]] == loose[i]
    assert got[900] == got[901] == got[902] == 900 and got[903] == got[904] == 903 and got[905] == 905 and got[906] == 906
    kept = N.keep_one(df, max_bucket=max_bucket)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(got.values()))


def test_one_large_group_in_crowded_buckets(spark):
    """Copies of one text, each with edits of its own: all reach each other by links, and one is left."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 5000, 250)]
    texts = [edited(rng, words, 2) for _ in range(300)] + [" ".join(f"o{i}x{j}" for j in range(60)) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(df, max_bucket=16).collect()) == [0, *range(300, 330)]


def test_small_components_of_a_crowded_bucket_are_compared(spark):
    """A bucket's first text is like none of the others, which are linked all the same."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, N.WORDS)
    far = [base ^ rng.integers(0, 1 << 62, N.WORDS) for _ in range(2)]
    prints = []
    for k in range(12):
        near = base.copy()
        near[3 + k % 5] ^= 1 << (k + 3)
        near[0] ^= 1 << k
        prints.append(near)
    for x in far:
        x[1:3] = base[1:3]
        x[0] = -x[0] - 1
        prints.append(x)
    least = [0] * len(N.LEAST)  # as if all had the same smallest hashes
    df = spark.createDataFrame([(*(int(v) for v in x), *least) for x in prints], ", ".join(f"{w} long" for w in [*N.PRINT, *N.LEAST]))
    _, roots = N.links(df, max_bucket=3)
    got = {}
    for r in roots.collect():
        got.setdefault(r.root, []).append(r.node)
    assert sorted(map(len, got.values()))[-1] == 12


def join_rows(spark, since):
    """Rows that left the joins of each execution after the first ``since``, by the most of one join."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(since, runs.size()):
        number = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_texts_that_share_keys_and_are_no_copies_make_no_rows(spark):
    """Sixty texts meet in each other's buckets; of 1,770 pairs three are links."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 62, N.WORDS)
    prints = []
    for k in range(60):
        x = rng.integers(0, 1 << 62, N.WORDS)
        x[:3] = base[:3]
        x[0] ^= (1 << (k % 30)) | (1 << (30 + k // 30))
        prints.append(x)
    for k in range(3):
        prints[k + 10][3:] = prints[k][3:]
    df = spark.createDataFrame([(*(int(v) for v in x), *[0] * len(N.LEAST)) for x in prints], ", ".join(f"{w} long" for w in [*N.PRINT, *N.LEAST]))
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    edges, roots = N.links(df)
    want = {(int(max(prints[k][0], prints[k + 10][0])), int(min(prints[k][0], prints[k + 10][0]))) for k in range(3)}
    assert {tuple(r) for r in edges.collect()} == want
    assert len({r.root for r in roots.collect()}) == 57
    assert join_rows(spark, since) <= 40 * 60  # of a text and its keys; the pairs that share a key were 1,770 rows more for the joins that follow


def test_recall_on_the_table(spark):
    """Of the pairs of different texts of at least 0.85 on sf0.1's first rows, most are linked; nothing below 0.65 is."""
    rows = spark.read.parquet(SF.replace("0.001", "0.1") + "/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(2500).collect()
    texts = [r.text for r in rows]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(df).collect()}
    strict, loose = exact_components(texts, 0.85), exact_components(texts, 0.65)
    linked = [i for i in range(len(texts)) if strict[i] != i]
    assert linked and sum(got[i] == got[strict[i]] for i in linked) >= 0.9 * len(linked)
    assert all(loose[got[i]] == loose[i] for i in range(len(texts)))


def test_keep_one_keeps_a_row_of_each_component(spark):
    """Null and repeated ids: unrelated texts stay, copies go."""
    words = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(8)
    text = [" ".join(words[i] for i in rng.integers(0, 200, 60)) for _ in range(6)]
    rows = [(None, text[0], "a"), (None, text[1], "a"), (None, text[0], "b"), (7, text[2], "a"), (7, text[3], "a"), (7, text[3], "b"), (9, text[4], "a"), (None, text[4], "a"), (8, text[4], "a"), (7, None, "a"), (None, "", "a"), (10, text[5], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted([(r.doc_id, r.text) for r in N.keep_one(df).collect()], key=str)
    assert kept == sorted([(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4]), (7, None), (10, text[5])], key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, row string")
    assert N.near_copies(empty).collect() == [] and N.keep_one(empty).collect() == []
