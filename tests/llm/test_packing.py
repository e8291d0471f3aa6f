from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tessera.llm import packing as P
from tessera.llm import queries


def check_places(rows, capacity=P.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def brute_pieces(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    out = []
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            out.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def test_pieces_and_places(spark):
    docs = [(1, "Hello, World! it's"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "word " * 5000), (5, "<|ENDOFTEXT|> a <|endoftext|>"), (6, "É éá 日本 \U0001f600!!\x1cq\x85r ΣΑΣ İ"), (7, "a" * 3000)]
    rows = P.pack_documents(spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, piece string"), queries.tokenizer_path()).collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute_pieces(docs)
    check_places(rows)


def test_query_on_table(spark):
    rows = queries.op4_packing(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(r)[:5] for r in rows], key=str) == brute_pieces(docs)
    assert check_places(rows) <= -(-sum(r.length for r in rows) // P.CAPACITY) + 3


def test_several_shards_and_islands(spark):
    rng = np.random.default_rng(1)
    parts = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 101, 400))]
    df = spark.createDataFrame(parts, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = P.pack(df, 100, shard=100, islands=3, epochs=3).collect()
    assert len(rows) == 400
    assert check_places(rows, 100) <= 1.1 * sum(p[3] for p in parts) / 100 + 4


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80), st.integers(0, 1000))
def test_crossover_keeps_every_item(lengths, seed):
    lengths, rng = np.array(lengths), np.random.default_rng(seed)
    a, b = P.first_packing(lengths, rng, 50), P.first_packing(lengths, rng, 50)
    child = P.crossover(lengths, a, b, rng, 50)
    assert sorted(i for x in child for i in x) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in x) <= 50 for x in child)
    assert [sorted(x) for x in P._decoded(P._coded(child, len(lengths)))] == [sorted(x) for x in child]


@pytest.mark.parametrize("seed", range(3))
def test_crossover_lowers_the_number_of_bins(seed):
    """No packing starts at the lower bound; what evolves from random ones comes within one bin of best fit decreasing, on lengths that rarely fill a bin."""
    lengths = np.sort(np.random.default_rng(seed).integers(20, 700, 3000))
    rng = np.random.default_rng([7, seed])
    first = [P.first_packing(lengths, rng, 1000) for _ in range(P.POPULATION)]
    best, done = P.evolve(lengths, list(first), rng, 1000, generations=12)
    decreasing: list[list[int]] = []
    P.best_fit(lengths.tolist(), list(range(len(lengths)))[::-1], decreasing, 1000)
    assert done > 0 and best[0] not in first
    assert -(-lengths.sum() // 1000) <= len(best[0]) <= min(len(decreasing) + 1, min(map(len, first)) - 10)


def test_islands_report_that_they_evolved(spark):
    """On the table's pieces the returned packing comes from crossover, and reaches the bound of each shard."""
    parts = P.tokenized_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), queries.tokenizer_path())
    lengths = np.sort([r.length for r in parts.filter("length < 2048").collect()]).astype(np.int32)
    gathered = spark.createDataFrame([(0, lengths.tobytes())], "shard int, lengths binary")
    for r in P.evolved(gathered, 1, P.CAPACITY).collect():
        assert r.first_bins > r.bins and r.generations >= 1
        assert r.bins == -(-int(lengths.sum()) // P.CAPACITY)


def test_repeated_rows_spread_over_shards(spark):
    parts = spark.createDataFrame([(None, 0, 0, 1, 0)] * 3000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = P.pack(parts, 100, shard=300).collect()
    assert len(rows) == 3000 and 30 <= check_places(rows, 100) <= 45
    shards = {}
    for r in rows:
        shards[r.sequence_id % 10] = shards.get(r.sequence_id % 10, 0) + 1
    assert len(shards) == 10 and max(shards.values()) < 400


def test_words_of_any_length_and_kind(spark):
    rng = np.random.default_rng(3)
    kinds = ["a", "Z", "é", "日", "\U0001f600", "1", ".", "'", "-", "_", " ", "\n", "\t", "\x0b", "\x1c", "\u00a0", "\u0130", "<", "|", ">", "the ", "ing"]
    docs = [(i, "".join(rng.choice(kinds, int(rng.integers(0, 400))))) for i in range(300)] + [(900, "x" * 300_000), (901, "ab1" * 50_000), (902, None)]
    rows = P.tokenized_pieces(spark.createDataFrame(docs, "doc_id long, text string"), queries.tokenizer_path()).collect()
    assert sorted(map(tuple, rows), key=str) == brute_pieces(docs)
