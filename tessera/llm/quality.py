"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: hashed words, the shape of each word (case, kind of
trailing marks), immediate repeats, repeated lines and the variety of its words.
Terms are weighted by log(1 + tf) * idf and projected by a truncated SVD that is
fitted on at most ``MAX_ROWS`` labelled rows.  Those rows' vectors (bounded, so
broadcast) are the voters: every document is compared with all of them by exact
cosines, in blocks, and the labels of its nearest ones count by similarity.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc32_text, pieces

#: Labelled rows used, at most: the first by a hash of the id.
MAX_ROWS = 4096
DIMENSIONS = 48
NEIGHBOURS = 15
#: Power of the similarity by which a neighbour's label counts.
SHARPNESS = 8
THRESHOLD = 0.3
BUCKETS = 1024
SHAPES = 512
EXTRA = 16
TERMS = BUCKETS + SHAPES + EXTRA
#: Words that a task keeps the terms of, none longer than WORD_BYTES.
CACHE = 60_000
WORD_BYTES = 32
_MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")


def word_terms(word: bytes) -> tuple[int, int]:
    """Bucket of the bare word and of its shape."""
    tail = _MARKS.search(word)
    marks = tail.group()[:3] if tail else b""
    bare = word[: len(word) - len(tail.group())] if tail else word
    text = bare.decode("utf-8", "replace")
    kind = "0" if any(c.isdigit() for c in text) else "-" if not text else "U" if text.isupper() and len(text) > 1 else "T" if text[:1].isupper() else "l" if text.islower() else "m"
    return xxhash.xxh32_intdigest(bare.lower()) % BUCKETS, BUCKETS + xxhash.xxh32_intdigest(kind.encode() + marks) % SHAPES


def term_counts(text: bytes | None, cache: dict) -> np.ndarray:
    """Counts of the ``TERMS`` terms of a whole text."""
    words, found = (text or b"").split(), []
    for w in words:
        pair = cache.get(w)
        if pair is None:
            pair = word_terms(w)
            if len(w) <= WORD_BYTES:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[w] = pair
        found.append(pair)
    counts = np.zeros(TERMS, np.float32)
    if words:
        counts += np.bincount(np.array(found).ravel(), minlength=TERMS)
        lines = [x for x in (text or b"").split(b"\n") if x.strip()]
        again = len(lines) - len(set(lines))
        variety = int(8 * len(set(words)) / len(words))
        repeats = sum(a == b for a, b in pairwise(words))
        counts[BUCKETS + SHAPES] = repeats
        counts[BUCKETS + SHAPES + 1] = again
        counts[BUCKETS + SHAPES + 2 + min(variety, 8)] = len(words)
    return counts


def weighted(counts: np.ndarray) -> np.ndarray:
    """log(1 + tf); the shape of a text weighs more than its words, and length cancels out."""
    share = counts / np.maximum(counts[:, :BUCKETS].sum(1, keepdims=True), 1) * 200
    out = np.log1p(share)
    out[:, :BUCKETS] *= 0.3
    return out


class LatentModel:
    """idf and projection of the terms; vectors (unit rows) and labels of the voters."""

    def __init__(self, idf, projection, vectors, labels, k=NEIGHBOURS, sharpness=SHARPNESS):
        self.idf, self.projection, self.vectors, self.labels, self.k, self.sharpness = idf, projection, vectors, labels, k, sharpness

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = (weighted(counts) * self.idf) @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest voters; the mean label where none is similar."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cos = np.maximum(self.embed(counts) @ self.vectors.T, 0)
        k = min(self.k, len(self.labels))
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(cos, near, 1).astype(np.float64) ** self.sharpness
        total = weight.sum(1)
        return np.where(total > 1e-12, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.labels.mean())


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> LatentModel:
    """An empty sample gives a model that scores 0.5."""
    if not len(labels):
        return LatentModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    idf = np.log((1 + len(labels)) / (1 + (counts > 0).sum(0))) + 0.2
    x = (weighted(counts) * idf).astype(np.float32)
    values, axes = np.linalg.eigh(x.T @ x)
    projection = axes[:, np.argsort(-values)[: min(dimensions, len(labels))]].astype(np.float32)
    model = LatentModel(idf.astype(np.float32), projection, None, labels.astype(np.float64))
    model.vectors = model.embed(counts).astype(np.float32)
    return model


def _count_batches(batches):
    cache: dict = {}
    for whole in batches:
        for batch in pieces(whole):
            rows = [term_counts(t, cache).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["label", "counts"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> LatentModel:
    """Fits on the labelled documents that are not held out (crc32 of the id as text, mod 5, is not 0).

    Rows with a null id or label are left out; of several labels of one id the
    highest counts, and of documents that share a labelled id the text with the
    smallest hash.
    """
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    seen = seen.filter(crc32_text(F.col("doc_id")) % 5 != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(one.alias("text"))
    got = found.select("label", "text").mapInArrow(_count_batches, "label int, counts binary").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, TERMS), np.float32), np.zeros(0))
    # a voter's place must not hang on the order in which tasks end
    rows = sorted(zip(got.column("counts").to_pylist(), got.column("label").to_pylist()))
    counts = np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(-1, TERMS)
    return fit(counts, np.array([min(max(r[1], 0), 1) for r in rows]))


def _scores(model: LatentModel, texts: list[bytes | None], cache: dict) -> np.ndarray:
    return np.round(model.score(np.stack([term_counts(t, cache) for t in texts])), 6)


def score(docs: DataFrame, model: LatentModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row.

    Empty and null texts are scored as texts without terms, long ones whole.
    Null ids and repeated rows are returned as they are.  Of voters that are
    equally near at the kth place any may vote; a score of ``threshold`` is
    enough.  Other columns, whatever their names, play no part; an empty table
    gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for whole in batches:
            for batch in pieces(whole):
                s = _scores(held.value, batch.column(1).cast(pa.binary()).to_pylist(), cache)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, predicted int")


def drop_poor(docs: DataFrame, model: LatentModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted 1, all columns kept, without a shuffle.

    Each row is judged by its own text: null ids, repeated rows and columns of
    any name stay as they are.
    """
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache: dict = {}
        for whole in batches:
            for batch in pieces(whole):
                s = _scores(held.value, batch.column(at).cast(pa.binary()).to_pylist(), cache)
                yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
