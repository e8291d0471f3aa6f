from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as S


def brute(docs):
    """(doc_id, fingerprint, component_id) by the definition, all pairs compared."""
    prints = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted([(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(docs, prints))], key=str)


def run(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted([tuple(r) for r in S.near_duplicates(df, **how).collect()], key=str)


def test_golay_decoding_is_perfect():
    index = S.golay_index()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 200)
    for w in words:
        code = np.nonzero(index == index[w])[0]
        assert len(code) == 2048


@pytest.mark.parametrize("flips", [0, 1, 2])
def test_near_fingerprints_share_a_key(flips):
    rng = np.random.default_rng(flips)
    for _ in range(400):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, flips, replace=False):
            b ^= 1 << int(bit)
        rows, keys = S.golay_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(60):
        text = [words[j] for j in rng.integers(0, 60, int(rng.integers(1, 90)))]
        docs.append((i * 3, " ".join(text)))
        if i % 3 == 0:
            near = list(text)
            near[-1] = "changed"
            docs.append((i * 3 + 1, " ".join(near)))
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "oNE\n"), (1003, "One"), (None, "one"), (None, "alone here nobody else"), (1005, "É é\x0bx"), (1006, "word " * 30000)]
    assert run(spark, docs) == brute(docs)


def test_crowded_keys_lose_no_link(spark):
    """Fingerprints around one point, with a bucket bound that sends them all the exact way."""
    base = 0x0123456789ABCDEF
    near = [base] + [base ^ (1 << b) for b in range(40)] + [base ^ (3 << b) ^ (1 << 60) for b in range(0, 40, 4)]
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in near], "fp long")
    wide = {tuple(r) for r in S.components(S.links(df, max_bucket=2)).collect()}
    plain = {tuple(r) for r in S.components(S.links(df, max_bucket=10_000)).collect()}
    assert wide == plain


def test_long_chain(spark):
    edges = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {r.root for r in S.components(edges).collect()} == {0}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(1, "a b c d", 7, 8), (2, "a b c d", 7, 8)], "doc_id long, text string, fp long, component_id long")
    assert [r.component_id for r in S.near_duplicates(df).collect()] == [1, 1]
