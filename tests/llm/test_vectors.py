from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tessera.llm import balltree, queries, rpforest
from tessera.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, score string"


def table_of(rng, n, dim=16):
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(dim)], "x") for i in range(n)]
    return rows


def odd_rows(dim=16):
    nan = [math.nan] + [1.0] * (dim - 1)
    return [(10_000, None, "x"), (10_100, [None] * dim, "x"), (10_200, nan, "x"), (10_300, [math.inf] + [0.0] * (dim - 1), "x"), (None, [1.0] * dim, "x"), (10_400, [], "x"), (10_500, [0.0] * dim, "x")]


def brute_ip(rows, k=10, every=100):
    good = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in good:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rows = table_of(np.random.default_rng(0), 700) + odd_rows()
    rows += [(701, rows[3][1], "tie"), (702, rows[3][1], "tie"), rows[5], (200_000, [1.0, 2.0], "other length"), (200_100, [1.0, 3.0], "other length")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, balltree.maximum_inner_product(df).collect())) == brute_ip(rows)


def test_rows_of_one_id_that_are_equal_as_whole_numbers_count_once(spark):
    rows = [(100, [1.0, 1.0], "x"), (100, [1.00001, 1.0], "x"), (7, [0.5, 0.5], "x"), (7, [0.50001, 0.5], "x")] + [(i, [i / 50, 0.25], "x") for i in range(8, 30)]
    got = sorted(map(tuple, balltree.maximum_inner_product(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute_ip(rows) and len({r[2] for r in got}) == len(got) == 10


def test_top_k_over_several_shards_and_waves(spark):
    rows = table_of(np.random.default_rng(1), 600)
    df = balltree.quantized(spark.createDataFrame(rows, SCHEMA))
    build = lambda ids, points, key: balltree.Shard(ids, points, 8)
    got = V.search(df, F.col("vec_id") % 20 == 0, 10, build, balltree.top_k, in_waves=True, shard=40)
    assert sorted(map(tuple, got.collect())) == brute_ip(rows, every=20)


def test_waves_cover_all_shards_once():
    for n in (1, 2, 4, 5, 16, 17, 1000):
        assert [i for a, b in V.waves(n) for i in range(a, b)] == list(range(n))
    assert len(V.waves(60_000)) < 10


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], "x"), (1, [2.0, 0.0], "x")], SCHEMA)
    assert [tuple(r) for r in balltree.maximum_inner_product(df).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert [(r.query_id, r.rank, r.vec_id) for r in rpforest.nearest_neighbours(df).collect()] == [(0, 1, 1)]
    for search in (balltree.maximum_inner_product, rpforest.nearest_neighbours):
        assert search(df.limit(0)).collect() == [] and search(df.filter("vec_id = 0")).collect() == []


def test_large_components_stay_exact():
    points = np.array([[2.0**29, 1.0], [2.0**29, 2.0], [1.0, 1.0]])
    shard = balltree.Shard(np.array([1, 2, 3]), points)
    q, i, s = balltree.top_k(shard, np.array([9]), points[:1].copy(), np.array([-np.inf]), 2)
    assert list(i) == [2, 1]


def test_ball_bounds_hold():
    rng = np.random.default_rng(2)
    points, queries_ = rng.integers(-900, 900, (500, 8)).astype(float), rng.integers(-900, 900, (20, 8)).astype(float)
    tree = balltree.BallTree(points, 16)
    upper = tree.bounds(queries_)
    for node, (a, b) in enumerate(tree.spans):
        assert (upper[:, node] >= (queries_ @ tree.points[a:b].T).max(1)).all()


def clustered(rng, n, dim=64, groups=60, spread=0.05):
    centres = rng.standard_normal((groups, dim))
    return centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim))


def test_ball_tree_prunes_where_rows_cluster():
    """A tenth of the leaves is opened of clustered rows; of rows without any structure in 64 dimensions nearly all are."""
    rng = np.random.default_rng(7)
    points = np.floor(1024 * clustered(rng, 8000))
    shard = balltree.Shard(np.arange(8000), points)
    q, i, s = balltree.top_k(shard, np.arange(50), points[:50], np.full(50, -np.inf), 10)
    assert shard.opened <= 0.1 * shard.leaves * shard.asked
    whole = points[:50] @ points.T
    whole[np.arange(50), np.arange(50)] = -np.inf
    assert (s.reshape(50, 10) == -np.sort(-whole, axis=1)[:, :10]).all()


def recall(rows, got, k=5, every=50):
    good = [(i, np.array(v)) for i, v, _ in rows]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    hits = total = 0
    for n, i in enumerate(ids):
        if i % every == 0:
            s = unit @ unit[n]
            s[n] = -2
            want = set(ids[np.argsort(-s)[:k]])
            hits += len(want & got.get(i, set()))
            total += k
    return hits / total


def test_forest_recall_and_scores(spark):
    rows = table_of(np.random.default_rng(3), 4000)
    df = spark.createDataFrame(rows + odd_rows(), SCHEMA)
    found = rpforest.nearest_neighbours(df).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert not set(by) & {10_000, 10_100, 10_200, 10_300, 10_500}
    assert recall(rows, by) >= 0.9
    v = {i: np.array(x) for i, x, _ in rows}
    for r in found[:50]:
        a, b = v[r.query_id], v[r.vec_id]
        assert abs(r.score - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-12


def test_queries_on_table(spark):
    rows = [(r.vec_id, list(r.embedding), "") for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op7_top_k(spark, SF).collect())) == brute_ip(rows)
    by = {}
    for r in queries.op9_neighbours(spark, SF).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert recall(rows, by) >= 0.9


def forest_recall(points, asked, seed, shards=1, k=5):
    """Recall of the forest over ``shards`` shards, and the share of rows that a query looks at."""
    ids, found, touched = np.arange(len(points)), {}, 0
    for part in range(shards):
        mine = ids[ids % shards == part]
        shard = rpforest.Shard(mine, points[mine], [seed, part])
        for n, i, s in zip(*rpforest.nearest(shard, asked, points[asked], k)):
            found.setdefault(n, []).append((-s, i))
        touched += shard.touched
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    cos = unit[asked] @ unit.T
    cos[np.arange(len(asked)), asked] = -2
    kth = -np.partition(-cos, k - 1, axis=1)[:, k - 1]
    hits = sum(cos[n, i] >= kth[n] for n, got in found.items() for _, i in sorted(got)[:k])
    return hits / (k * len(asked)), touched / len(asked) / len(points)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_recall_with_every_row_a_query(spark, seed):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()
    points = np.array([r.embedding for r in rows], float)
    got, touched = forest_recall(points, np.arange(len(points)), seed)
    assert got >= 0.9 and touched <= 0.66


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_recall_over_several_shards(seed):
    """Without any structure in 64 dimensions, which is hardest."""
    points = np.random.default_rng(seed).standard_normal((24_000, 64))
    got, touched = forest_recall(points, np.arange(0, 24_000, 240), seed, shards=3)
    assert got >= 0.9 and touched < 1 / 3


def test_forest_on_a_full_shard_looks_at_less_than_a_third():
    points = np.random.default_rng(4).standard_normal((V.SHARD, 64))
    got, touched = forest_recall(points, np.arange(0, V.SHARD, 160), 4)
    assert got >= 0.9 and touched < 1 / 3


def test_forest_queue_takes_the_nearest_leaves_first():
    """The leaves taken are those of the smallest sums of squared margins, as told by all leaves of all trees."""
    rng = np.random.default_rng(6)
    points = rng.standard_normal((900, 8))
    forest = rpforest.Forest(points, 1, trees=5, leaf=20)
    for query in rng.standard_normal((10, 8)):
        leaves = []
        for tree in range(5):
            for leaf in range(2**forest.depth):
                gap, node = 0.0, 0
                for level in range(forest.depth):
                    margin, side = forest.normals[level, tree] @ query - forest.cuts[level][tree, node], leaf >> (forest.depth - 1 - level) & 1
                    gap, node = gap + (margin**2 if side != (margin > 0) else 0.0), 2 * node + side
                leaves.append((gap, tree, leaf))
        want = set()
        for _, tree, leaf in sorted(leaves):
            if len(want) >= 200:
                break
            want |= set(forest.order[tree, forest.starts[leaf] : forest.starts[leaf + 1]].tolist())
        got = set(forest.candidates(query, 200).tolist())
        assert got == want


def test_search_streams_several_shards_and_dims(spark):
    rng = np.random.default_rng(5)
    rows = table_of(rng, 400) + [(10_000 + i, v, "x") for i, v, _ in table_of(rng, 300, 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = lambda shard, ids, queries, bounds, k: rpforest.nearest(shard, ids, queries, k, 1.0)
    got = V.search(rpforest.finite(df), F.col("vec_id") % 50 == 0, 5, lambda ids, p, key: rpforest.Shard(ids, p, 1), whole, shard=60, score="double").collect()
    for dim, low in ((16, 0), (8, 10_000)):
        mine = [r for r in rows if len(r[1]) == dim]
        by = {}
        for r in got:
            if (r.query_id >= 10_000) == (low == 10_000):
                by.setdefault(r.query_id, set()).add(r.vec_id)
        assert recall(mine, by) == 1.0
