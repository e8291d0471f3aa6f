"""Removal of repeated word passages by a De Bruijn graph of word k-mers.

Words k-1 in a row are nodes, k in a row an edge.  An edge that several
documents hold has a source, the least id of them.  Documents are packed into
blocks; each block tells its different edges (hash and least id, sorted, packed
by ranges of the hash), the ranges find the repeated edges with their sources,
and a join takes these back to the blocks.  There the repeated edges that follow
one another without a change of source are compacted into paths, and so are the
edges that a document is the source of.  A second join meets each different path
with the paths of its source document and verifies it word by word.

An edge goes through the shuffle once for each block that holds it, however many
documents of the block do, so a passage of a third of all documents costs a row
part for each block and no more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, written

#: Words of an edge.
K = 13
#: Bytes of text of a block, about (one document may have more).
BLOCK_BYTES = 2 << 20
#: Edges of a range of the hash, about, and the least number of ranges (a power of two).
RANGE, LEAST_BITS = 1 << 21, 7
#: Odd multipliers of the two rolling hashes.
FIRST, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SEED = 11
ATTEMPTS = 3

_BLOCKS = "block long, ids array<long>, words array<int>, texts binary"
_EDGES = "bucket int, block long, n int, edges binary"
_FOUND = "kind int, doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,n_words:long,src:long>>, src long, path string"


def _pack_batches(batches):
    """Blocks of documents by id (null ids last): their words, one space between, a line a document."""
    task, number, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=11)

    def block(held):
        nonlocal number
        held.sort(key=lambda d: (d[0] is None, d[0] or 0))
        key, number = (task << 33) + number, number + 1
        ids, words = pa.array([[d[0] for d in held]], pa.list_(pa.int64())), pa.array([[d[1] for d in held]], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([key]), ids, words, pa.array([press.compress(b"\n".join(d[2] for d in held))], pa.binary())], ["block", "ids", "words", "texts"])

    held, size = [], 0
    for whole in batches:
        for batch in by_bytes(whole, 1, BLOCK_BYTES):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                held.append((doc_id, len(words), b" ".join(words)))
                size += len(held[-1][2])
                if size >= BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
    if held:
        yield block(held)


def rolling(words: list[bytes], seed: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each K words in a row (the second is zero unless asked for)."""
    m = len(words) - K + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    known = coded.dictionary.to_pylist()

    def one(base, salt):
        each = np.array([xxhash.xxh64_intdigest(w, salt) for w in known], np.uint64)[coded.indices.to_numpy()]
        h = np.zeros(m, np.uint64)
        for j in range(K):
            h = h * base + each[j : j + m]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    return one(FIRST, seed), one(SECOND, seed + 1) if second else np.zeros(m, np.uint64)


class Edges:
    """The edges of a block: where they start, whose they are and which are the same."""

    def __init__(self, ids: list, counts: list[int], texts: bytes, seed: int, extra: int):
        self.words = zstandard.ZstdDecompressor().decompress(texts).split()
        self.counts = np.array(counts, np.int64)
        known = np.array([i is not None for i in ids], bool)
        values = np.array([i or 0 for i in ids], np.int64)
        h, g = rolling(self.words, seed, extra > 0)
        owner = np.repeat(np.arange(len(ids)), self.counts)
        # an edge lies within one document, and that has an id
        at = np.flatnonzero((owner[: len(h)] == owner[K - 1 :]) & known[owner[: len(h)]]) if len(h) else np.zeros(0, np.int64)
        self.at, self.owner, h, g = at, owner[at], h[at], g[at] >> np.uint64(64 - 8 * extra if extra else 0)
        self.doc = values[self.owner]
        order = np.lexsort((g, h)) if extra else np.argsort(h, kind="stable")
        new = _changes(h[order], g[order])
        #: of each different edge its hashes and least id (documents are in order of their ids), of each edge its number
        first = order[new]
        self.h, self.g, self.least = h[first], g[first], self.doc[first]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        #: several documents of the block have it
        most = np.full(len(first), np.iinfo(np.int64).min)
        np.maximum.at(most, self.group, self.doc)
        self.shared = most > self.least


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before; the first does."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _press(press, extra: int, h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> bytes:
    """Ascending hashes (or places) as differences, with ids, byte by byte of all rows together."""
    planes = lambda a, n=8: np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()
    return press.compress(planes(np.diff(h, prepend=np.uint64(0))) + planes(ids) + (planes(g, extra) if extra else b""))


def _unpress(data: bytes, n: int, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(16 + extra, n)
    whole = lambda planes: np.ascontiguousarray(planes.T).view(np.uint64)[:, 0]
    g = whole(np.vstack([raw[16:], np.zeros((8 - extra, n), np.uint8)])) if extra else np.zeros(n, np.uint64)
    return np.cumsum(whole(raw[:8]), dtype=np.uint64), g, whole(raw[8:16]).view(np.int64)


def _blocks_of(batches) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(c[at].as_py() for c in batch.columns)


def _cuts(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of sorted hashes starts, and the end."""
    inner = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return np.concatenate([[0], inner, [len(h)]])


def _edge_batches(bits: int, extra: int, seed: int):
    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for block, ids, counts, texts in _blocks_of(batches):
            e = Edges(ids, counts, texts, seed, extra)
            cuts = _cuts(e.h, bits)
            spans = [(b, a, z) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.int64()), pa.array([z - a for _, a, z in spans], pa.int32()), pa.array([_press(press, extra, e.h[a:z], e.g[a:z], e.least[a:z]) for _, a, z in spans], pa.binary())],
                ["bucket", "block", "n", "edges"],
            )

    return run


def _source_batches(extra: int):
    """For each block of a range the places, in its list, of the edges that other blocks have too, with their sources."""

    def solve(rows):
        press = zstandard.ZstdCompressor(level=1)
        parts = [_unpress(r[3], r[2], extra) for r in rows]
        h, g, ids = (np.concatenate(c) for c in zip(*parts))
        row = np.repeat(np.arange(len(rows)), [r[2] for r in rows])
        order = np.lexsort((ids, g, h)) if extra else np.lexsort((ids, h))
        new = _changes(h[order], g[order])
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1)[group]
        source = np.empty(len(order), np.int64)
        source[order] = ids[order[new]][group]
        told = np.zeros(len(order), bool)
        told[order] = several
        ends = np.cumsum([r[2] for r in rows])
        for i, r in enumerate(rows):
            span = slice(ends[i] - r[2], ends[i])
            mark = told[span]
            if mark.any():
                places = np.flatnonzero(mark).astype(np.uint64)
                yield r[0], r[1], len(places), _press(press, 0, places, places[:0], source[span][mark])

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            for r in _blocks_of([batch]):
                if r[0] != bucket and held:
                    yield _rows(solve(held))
                    held = []
                bucket = r[0]
                held.append(r)
        if held:
            yield _rows(solve(held))

    return run


def _rows(found) -> pa.RecordBatch:
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("edges", pa.binary())])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in found], schema=schema)


def _paths(e: Edges, marked: np.ndarray, source: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document of the block, first word, words, source) of the marked edges that follow one another with one source."""
    own = np.flatnonzero(marked)
    if not len(own):
        return
    at, owner, src = e.at[own], e.owner[own], source[own]
    new = _changes(at - np.arange(len(at)), owner, src)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(own)) - 1
    for a, z in zip(starts, ends):
        yield int(owner[a]), int(at[a]), int(at[z] - at[a]) + K, int(src[a])


def _found_batches(bits: int, extra: int, seed: int):
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("src", pa.int64())]))), ("src", pa.int64()), ("path", pa.string())])

    def one(ids, counts, texts, told):
        e = Edges(ids, counts, texts, seed, extra)
        source, shared = e.least.copy(), e.shared.copy()
        starts = _cuts(e.h, bits)
        for t in told or ():
            places, _, src = _unpress(t["edges"], t["n"], 0)
            mine = places.astype(np.int64) + starts[t["bucket"]]
            source[mine], shared[mine] = src, True
        source, shared = source[e.group], shared[e.group]
        removed = source < e.doc
        cover = np.zeros(len(e.words) + 1, np.int64)
        np.add.at(cover, e.at[removed], 1)
        np.add.at(cover, e.at[removed] + K, -1)
        covered = np.cumsum(cover)[:-1] > 0
        text = lambda a, n: b" ".join(e.words[a : a + n]).decode("utf-8", "replace")
        ends = np.cumsum(e.counts)
        spans, paths = {}, set()
        for owner, a, n, src in _paths(e, removed, source):
            spans.setdefault(owner, []).append({"start": a - int(ends[owner] - e.counts[owner]), "n_words": n, "src": src})
            paths.add((src, text(a, n)))
        for i, doc_id in enumerate(ids):
            a, z = int(ends[i] - e.counts[i]), int(ends[i])
            gone = covered[a:z]
            kept = [w for w, x in zip(e.words[a:z], gone) if not x] if gone.any() else e.words[a:z]
            yield 0, doc_id, z - a, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), spans.get(i, []), None, None
        for src, path in paths:
            yield 1, None, None, None, None, None, src, path
        for _, a, n, src in _paths(e, shared & (source == e.doc), source):
            yield 2, None, None, None, None, None, src, text(a, n)

    def run(batches):
        for _, ids, counts, texts, told in _blocks_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*one(ids, counts, texts, told)), schema)], schema=schema)

    return run


def _unverified(found: DataFrame) -> DataFrame:
    """The paths (src, path) that their source document does not hold word by word."""
    # each block tells a path once; its copies in other blocks are checked there and then, not gathered first
    paths = found.filter("kind = 1").select("src", "path")
    # the paths of one document: no more text than it has
    held = found.filter("kind = 2").groupBy("src").agg(F.collect_list("path").alias("held"))
    has = lambda c: F.exists("held", lambda r: F.concat(F.lit(" "), r, F.lit(" ")).contains(F.concat(F.lit(" "), c, F.lit(" "))))
    words = F.split("path", " ")
    edges = F.transform(F.sequence(F.lit(1), F.size(words) - (K - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(K)), " "))
    sound: Column = F.when(has(F.col("path")), True).otherwise(F.forall(edges, has))
    return paths.join(held, "src", "left").filter(~F.coalesce(sound, F.lit(False))).select("src", "path")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and spans (start, n_words, src), the compacted paths that are removed.

    A word is removed if a window of K words that covers it also starts in a
    document with a smaller id.  Rows that share an id lose nothing to each other
    and are each returned; rows with a null id neither lose words nor take any.
    Null and empty texts, and those under K words, keep what they have.  Other
    columns, whatever their names, play no part; an empty table gives an empty
    result.

    Edges are told apart by 64 bits and as many bytes more as keep a false match
    improbable in all of the input; every path is verified, and one that fails
    (a false match) makes the search start again with another seed.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(narrow.mapInArrow(_pack_batches, _BLOCKS), "passage-blocks")
    total = blocks.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, total) / RANGE)) if total > RANGE else 0)
    extra = min(8, max(0, math.ceil((2 * math.log2(max(2, total)) + 9 - 64) / 8)))
    for seed in range(SEED, SEED + 2 * ATTEMPTS, 2):
        edges = blocks.mapInArrow(_edge_batches(bits, extra, seed), _EDGES).repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
        told = edges.mapInArrow(_source_batches(extra), _EDGES)
        # the edges of one block: as bounded as the block
        told = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "edges")).alias("told"))
        met = blocks.join(told, "block", "left").select("block", "ids", "words", "texts", "told")
        found = written(met.mapInArrow(_found_batches(bits, extra, seed), _FOUND), "passages", compression="zstd")
        if _unverified(found).isEmpty():
            return found.filter("kind = 0").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")
    raise RuntimeError(f"false matches with {ATTEMPTS} seeds")
