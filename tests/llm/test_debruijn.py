from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tessera.llm import debruijn as D
from tessera.llm import queries


def brute(rows, k=13):
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for at in range(len(words) - k + 1):
            if i is not None:
                key = tuple(words[at : at + k])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for at in range(len(words) - k + 1):
            if i is not None and least[tuple(words[at : at + k])] < i:
                gone[at : at + k] = [True] * k
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()))
    return Counter(out)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return Counter(tuple(r)[:4] for r in D.repeated_passages(df, **how).collect())


def made(seed, n=80, words=40):
    """Texts of a small vocabulary with copied passages, some periodic."""
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(n):
        text = [f"w{j}" for j in rng.integers(0, words, int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 3))):
            if texts:
                other = texts[int(rng.integers(0, len(texts)))]
                a = int(rng.integers(0, len(other) + 1))
                text[len(text) // 2 : len(text) // 2] = other[a : a + int(rng.integers(10, 40))]
        if i % 9 == 0:
            text += ["a", "b"] * int(rng.integers(6, 20))
        texts.append(text)
    ids = rng.permutation(n)
    return [(int(i), " ".join(t)) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed, monkeypatch):
    rows = made(seed)
    assert run(spark, rows) == brute(rows)


def test_edges_of_input(spark):
    p = " ".join(f"x{i}" for i in range(20))
    rows = [(1, p), (1, p), (2, "\x0b" + p.replace(" ", "\n\t") + "\x1f"), (3, None), (4, ""), (5, " \n"), (None, p), (None, None), (6, "é " + p + "  "), (7, "same " * 5000), (8, "same " * 13), (9, "same " * 12), (10, " ".join(f"x{i}" for i in range(12))), (-4, p + " tail")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()
    df = spark.createDataFrame([(1, p, 5, "a"), (2, p, 5, "b")], "doc_id long, text string, block long, path string")
    assert [(r.doc_id, r.n_removed, [tuple(s) for s in r.spans]) for r in D.repeated_passages(df).orderBy("doc_id").collect()] == [(1, 0, []), (2, 20, [(0, 20, 1)])]


def test_blocks_and_wide_hashes(spark, monkeypatch):
    """One block a document, and two bytes of the second hash."""
    rows = made(7, 40)
    blocks = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    monkeypatch.setattr(D.math, "log2", lambda x: 36.0 if x > 100 else 1.0)
    monkeypatch.setattr(D, "RANGE", 1 << 60)
    assert Counter(tuple(r)[:4] for r in D.repeated_passages(blocks).collect()) == brute(rows)


def test_false_matches_are_found(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(15)) for c in "pq")
    rows = [(1, 1, p), (1, 2, p), (2, 1, f"w {p}"), (1, 3, q), (2, 4, q.replace("q3", "other"))]
    found = spark.createDataFrame(rows, "kind int, src long, path string")
    assert {tuple(r) for r in D._unverified(found).collect()} == {(2, p), (3, q)}
    apart = " ".join(f"p{i}" for i in range(13)) + " z " + " ".join(f"p{i}" for i in range(1, 14))
    found = spark.createDataFrame([(1, 1, " ".join(f"p{i}" for i in range(14))), (2, 1, apart)], "kind int, src long, path string")
    assert D._unverified(found).isEmpty()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_passages(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
