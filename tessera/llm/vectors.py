"""What the vector searches share: clean vectors and shards that queries stream past.

A stated query set is searched against all rows in blocks.  Rows are dealt by
hash into shards of a bounded size and shuffled once.  Each task gets a shard's
rows first and its queries after them: it builds the shard's index from the rows
and then searches one batch of queries after the other, so no index is built
twice and no query set is held whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Rows of a shard, about: what a task holds at a time.
SHARD = 16384
#: Queries that are searched at a time.
BLOCK = 512
#: Later waves have so many times the shards of all waves before them.
WAVE = 3
#: Tasks of a wave, at most; beyond it a task takes several shards.
MAX_TASKS = 100_000


def finite(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", once: bool = True) -> DataFrame:
    """(vec_id, v) without null ids, null or empty vectors and those with null or non-finite components; repeated rows once, unless all are asked for."""
    v = F.col("v")
    sound = F.size(v) > 0
    sound = sound & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.distinct() if once else kept


def waves(shards: int) -> list[tuple[int, int]]:
    """Spans of shards, each WAVE times as many as all before: the score reached so far is passed on after each."""
    spans, at, size = [], 0, 1
    while at < shards:
        spans.append((at, min(shards, at + size)))
        at += size
        size = WAVE * at
    return spans


def search(rows: DataFrame, is_query: Column, k: int, build: Callable, ask: Callable, in_waves: bool = False, shard: int = SHARD, score: str = "long") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, its own id left out.

    ``build(ids, matrix, key)`` makes the index of a shard; ``ask(index,
    query_ids, queries, bounds, k)`` gives arrays (query number, id, score).
    With ``in_waves`` the shards are searched a few at a time and ``bounds`` has
    the kth score that a query reached in the waves before; -inf where it has
    none.  Vectors of different lengths are not compared.
    """
    total = rows.count()
    shards = max(1, -(-total // shard))
    rows = written(rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")), "vectors")
    queries = rows.filter(is_query).select("vec_id", "v", "dim", F.xxhash64("vec_id", "v").alias("qkey"))
    schema = f"qkey long, query_id long, vec_id long, score {score}"

    def run(first: int, end: int, bounds: DataFrame | None) -> DataFrame:
        asked = queries.join(bounds, "qkey", "left") if bounds is not None else queries.withColumn("bound", F.lit(None).cast("double"))
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(end - 1)))).withColumn("asks", F.lit(True))
        held = rows.filter(F.col("shard").between(first, end - 1)).withColumns({"qkey": F.lit(None).cast("long"), "bound": F.lit(None).cast("double"), "asks": F.lit(False)})
        both = held.unionByName(asked).select("dim", "shard", "asks", "vec_id", "qkey", "bound", "v")
        dealt = both.repartition(min(end - first, MAX_TASKS), "dim", "shard").sortWithinPartitions("dim", "shard", "asks", "vec_id", "qkey")
        return dealt.mapInArrow(_stream(build, ask, k, score), schema)

    order = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found, bounds = None, None
    for first, end in waves(shards) if in_waves else [(0, shards)]:
        now = run(first, end, bounds)
        found = now if found is None else found.unionByName(now)
        if end < shards:
            found = written(best(found).drop("rank"), "vectors-best")
            bounds = found.groupBy("qkey").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bound")).filter(F.col("n") >= k).select("qkey", "bound")
    return best(found).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def _stream(build: Callable, ask: Callable, k: int, score: str):
    kind = np.int64 if score == "long" else np.float64

    def run(batches):
        key, ids, vectors, index = None, [], [], None
        for whole in batches:
            shards, asks = whole.column(1).to_numpy(), whole.column(2).to_numpy(zero_copy_only=False)
            dims = whole.column(0).to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(dims) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)]):
                if a == b:
                    continue
                part, here = whole.slice(a, b - a), (int(dims[a]), int(shards[a]))
                if here != key:
                    key, ids, vectors, index = here, [], [], None
                numbers = part.column(3).to_numpy()
                if not asks[a]:
                    ids.append(numbers), vectors.append(_matrix(part.column(6), here[0]))
                    continue
                if index is None and ids:
                    index = build(np.concatenate(ids), np.concatenate(vectors), here)
                    ids, vectors = [], []
                if index is None:
                    continue
                qkeys, bounds = part.column(4).to_numpy(), part.column(5).to_numpy(zero_copy_only=False)
                for at in range(0, b - a, BLOCK):
                    span = slice(at, min(at + BLOCK, b - a))
                    own, limits = numbers[span], np.nan_to_num(bounds[span].astype(np.float64), nan=-np.inf)
                    q, near, scores = ask(index, own, _matrix(part.column(6).slice(at, len(own)), here[0]), limits, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qkeys[span][q]), pa.array(own[q]), pa.array(near), pa.array(np.asarray(scores, kind))], ["qkey", "query_id", "vec_id", "score"])

    return run
