"""Approximate nearest neighbours by a forest of random-projection trees.

Every row is in every tree of its shard.  A tree splits its rows at the median
of a random direction, one for each level.  The nodes of all trees that a query
has not entered wait in one priority queue by the sum of the query's squared
margins to the splits it stands on the wrong side of.  The nearest node is taken
and descended to one leaf, the other child of each split on the way goes into
the queue; this ends when the leaves taken hold ``TOUCHED`` of the shard's rows
(``LEAST`` a wanted neighbour at least).  All of these rows, each once, are
reranked by exact cosines in double precision; no other row is looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import finite, search

TREES = 48
LEAF = 32
#: Part of a shard's rows that a query looks at, and their number for each wanted neighbour at least.
TOUCHED = 0.32
LEAST = 256
SEED = 11


class Forest:
    """Balanced trees of equal depth over unit rows.

    ``normals`` has a random direction for each level and tree, ``cuts[d]`` the
    medians at which the nodes of level d (tree, node) are split; ``order`` has
    each tree's rows in the order of its leaves, which begin at ``starts``.
    """

    def __init__(self, points: np.ndarray, seed, trees: int = TREES, leaf: int = LEAF):
        n, width = points.shape
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        normals = np.random.default_rng(seed).standard_normal((self.depth, trees, width))
        self.normals = normals / np.sqrt((normals**2).sum(-1, keepdims=True))
        self.trees, self.cuts, self.starts = trees, [], np.array([0, n])
        self.order = np.tile(np.arange(n), (trees, 1))
        for level in self.normals:
            sizes = np.diff(self.starts)
            node, half = np.repeat(np.arange(len(sizes)), sizes), (sizes + 1) // 2
            middle = self.starts[:-1] + half
            cuts = np.empty((trees, len(sizes)))
            for t, along in enumerate(level @ points.T):
                mine = along[self.order[t]]
                place = np.lexsort((mine, node))
                self.order[t], mine = self.order[t][place], mine[place]
                cuts[t] = (mine[middle - 1] + mine[np.minimum(middle, self.starts[1:] - 1)]) / 2
            self.cuts.append(cuts)
            self.starts = np.sort(np.concatenate([self.starts, middle]))

        self.splits = [level.tolist() for level in self.cuts]

    def candidates(self, query: np.ndarray, wanted: int) -> np.ndarray:
        """Rows of the leaves nearest to a unit vector over all trees, as many leaves as hold ``wanted`` different rows."""
        along, splits, starts = (self.normals @ query).tolist(), self.splits, self.starts
        queue = [(0.0, tree, 0, 0) for tree in range(self.trees)]
        seen, met = np.zeros(self.order.shape[1], bool), 0
        while queue and met < wanted:
            distance, tree, level, node = heapq.heappop(queue)
            for level in range(level, self.depth):
                margin = along[level][tree] - splits[level][tree][node]
                near = 2 * node + (margin > 0)
                heapq.heappush(queue, (distance + margin * margin, tree, level + 1, near ^ 1))
                node = near
            rows = self.order[tree, starts[node] : starts[node + 1]]
            met += len(rows) - np.count_nonzero(seen[rows])
            seen[rows] = True
        return np.flatnonzero(seen)


class Shard:
    """A shard's rows and their forest."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, seed):
        self.ids, self.points, self.norms = ids, points, np.sqrt((points * points).sum(1))
        self.forest, self.touched = Forest(points / self.norms[:, None], seed), 0


def nearest(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, k: int, touched: float = TOUCHED):
    """(query number, id, cosine) of the k best candidates of each query."""
    qnorms = np.sqrt((queries * queries).sum(1))
    wanted = max(LEAST * k, int(touched * len(shard.ids)))
    out_q, out_i, out_s = [], [], []
    for n, query in enumerate(queries):
        rows = shard.forest.candidates(query / qnorms[n], wanted)
        shard.touched += len(rows)
        rows = rows[shard.ids[rows] != query_ids[n]]
        score = (shard.points[rows] * query).sum(1) / (shard.norms[rows] * qnorms[n])
        best = np.lexsort((shard.ids[rows], -score))[:k]
        out_q.append(np.full(len(best), n)), out_i.append(shard.ids[rows[best]]), out_s.append(score[best])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k nearest rows found.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without an id; repeated rows count once; rows of
    the query's own id are not its candidates; equal scores are told apart by
    the smaller id.  All but ids and vectors is passed over, whatever its name.
    An empty table, or one without queries, gives an empty result.
    """
    rows = finite(vectors).filter(F.exists("v", lambda x: x != 0))
    build = lambda ids, points, key: Shard(ids, points, [seed, *key])
    return search(rows, F.col("vec_id") % every == 0, k, build, lambda shard, ids, queries, bounds, k: nearest(shard, ids, queries, k), score="double")
