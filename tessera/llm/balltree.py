"""Exact maximum inner product search by ball-tree branch and bound.

Each shard has a ball tree, built once; queries stream past it.  A query visits
its nodes in the order of the upper bound q.c + |q| r on any inner product
inside the ball, and stops when no node can reach the kth score so far.  That
score is shared: shards are searched in waves, each three times as large as all
before, and starts from the kth score reached in them.  Ties are kept, so the
smaller id wins.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import finite, search

LEAF = 32


def _axis(own: np.ndarray, rounds: int = 4) -> np.ndarray:
    """About the principal direction of centred rows, by a few power steps from the farthest of them."""
    axis = own[(own * own).sum(1).argmax()]
    for _ in range(rounds):
        step = own.T @ (own @ axis)
        size = np.sqrt(step @ step)
        if size == 0:
            break
        axis = step / size
    return axis


class BallTree:
    """Nodes as arrays: centre, radius, children (-1 for leaves) and the span of rows below."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        centres, radii, left, right, spans = [], [], [], [], []
        stack = [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = points[self.order[a:b]]
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            node = len(centres)
            centres.append(centre), radii.append(away.max()), left.append(-1), right.append(-1), spans.append((a, b))
            if parent >= 0:
                (left if side == 0 else right)[parent] = node
            if b - a > leaf and radii[-1] > 0:
                place = np.argsort((own - centre) @ _axis(own - centre), kind="stable")
                self.order[a:b] = self.order[a:b][place]
                middle = (a + b) // 2
                stack += [(a, middle, node, 0), (middle, b, node, 1)]
        self.centres, self.radii, self.left, self.right, self.spans = np.array(centres), np.array(radii), left, right, spans
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all nodes, a little above what rounding can lose."""
        norms = np.sqrt((queries**2).sum(1))[:, None]
        upper = queries @ self.centres.T + norms * self.radii[None, :]
        return upper + 1e-9 * (1 + norms * (np.abs(self.centres).max() + self.radii[None, :]) * np.sqrt(queries.shape[1]))


def _dot(points: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Whole inner products: in doubles where these are exact, else in Python's integers."""
    if exact:
        return points @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(p, query)) for p in points], object)


class Shard:
    """A shard's rows in the order of their tree; ``opened`` and ``asked`` count leaves for each query."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.tree = BallTree(points, leaf)
        self.ids, self.most = ids[self.tree.order], np.abs(points).max(initial=0)
        self.leaves, self.opened, self.asked = sum(x < 0 for x in self.tree.left), 0, 0


def top_k(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int):
    """(query number, id, score) of the k best rows of each query that reach its bound."""
    tree, row_ids = shard.tree, shard.ids
    exact = queries.shape[1] * shard.most * np.abs(queries).max(initial=0) < 2**53
    upper = tree.bounds(queries)
    out: list[tuple[int, int, int]] = []
    shard.asked += len(queries)
    for n, query in enumerate(queries):
        kth, own, up = bounds[n], query_ids[n], upper[n]
        got_s, got_i = np.zeros(0), np.zeros(0, np.int64)
        heap = [(-up[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if tree.left[node] >= 0:
                for child in (tree.left[node], tree.right[node]):
                    if up[child] >= kth:
                        heapq.heappush(heap, (-up[child], child))
                continue
            a, b = tree.spans[node]
            shard.opened += 1
            s = _dot(tree.points[a:b], query, exact)
            keep = (s >= kth) & (row_ids[a:b] != own)
            if keep.any():
                s, i = np.concatenate([got_s, s[keep]]), np.concatenate([got_i, row_ids[a:b][keep]])
                best = np.lexsort((i, -s))[:k]
                got_s, got_i = s[best], i[best]
                if len(best) == k:
                    kth = max(kth, got_s[-1])
        out += [(n, int(i), int(s)) for i, s in zip(got_i, got_s)]
    table = np.array(out, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each finite vector, whole numbers held as doubles; rows that are equal then are one."""
    clean = finite(vectors, once=False)
    return clean.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")).distinct()


def maximum_inner_product(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k highest inner products.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without an id; rows of one id count once where they are equal
    as whole numbers; rows of the
    query's own id are not its candidates.  Scores must fit a long.  All but ids
    and vectors is passed over, whatever its name.  An empty table, or one
    without queries, gives an empty result.
    """
    build = lambda ids, points, key: Shard(ids, points)
    return search(quantized(vectors, scale), F.col("vec_id") % every == 0, k, build, top_k, in_waves=True)
