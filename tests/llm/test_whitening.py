from __future__ import annotations

import math

import numpy as np
import pytest

from tests.conftest import SF
from tessera.llm import queries
from tessera.llm import whitening as W


def sound(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, k=32):
    """(sorted ids, x, eigenvalues, eigenvectors, trace) with the whole covariance."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if sound(v)]
    x = np.array([v for _, v in kept], np.int64)
    c = (x * len(x) - x.sum(0)) / len(x)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return kept, c, values[::-1][:k], vectors[:, ::-1][:, :k], values.sum()


def check(got, rows, k=32, gap=1e-3):
    kept, c, values, vectors, trace = brute(rows, k)
    values = values[values > 1e-12 * values[0]]
    n, dims = len(kept), c.shape[1]
    assert len(got) == n * len(values) and all(r.n == n for r in got)
    exact = {}
    sums = [sum(v[j] for _, v in kept) for j in range(dims)]
    for i, v in kept:
        exact.setdefault(i, set()).add(sum((n * a - s) ** 2 for a, s in zip(v, sums)))
    assert all(r.deviation in exact[r.vec_id] for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for j, value in enumerate(values):
        mine = [r for r in got if r.component == j + 1]
        assert all(abs(r.explained - value / trace) <= 1e-9 for r in mine)
        others = np.abs(np.delete(values, j) - value)
        if len(others) and others.min() < gap * value:
            continue
        want = c @ vectors[:, j] / math.sqrt(value)
        a, b = np.sort([r.whitened for r in mine]), np.sort(want)
        assert min(np.abs(a - b).max(), np.abs(a + b[::-1]).max()) < 1e-8


@pytest.mark.parametrize("shape", [(300, 6), (90, 40), (20, 64)])
def test_against_the_whole_covariance(spark, shape):
    rng = np.random.default_rng(sum(shape))
    x = rng.standard_normal(shape) * np.linspace(3, 0.2, shape[1]) + rng.standard_normal(shape[1]) * 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    check(W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, x array<long>, n long"
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]
    good = [(6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [0.5, -2.0]), (8, [-3.0, 0.25])]
    df = spark.createDataFrame([(*r, [1], 2) for r in odd + good], schema)
    check(W.whiten(df).collect(), good)
    assert W.whiten(df.filter("vec_id < 6")).collect() == []
    assert W.whiten(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], [1], 2) for i in range(4)], schema)
    assert W.whiten(same).collect() == []
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0], [1], 2)], schema)).collect() == []
    with pytest.raises(ValueError, match="entries"):
        W.whiten(spark.createDataFrame([(1, [1.0], [1], 2), (2, [1.0, 2.0], [1], 2)], schema))


def test_deviations_beyond_int64_steps(spark):
    rows = [(i, [float((-1) ** i * 6_800_000), 1.0]) for i in range(5)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, rows)
    far = [(i, [float((-1) ** i * 10**8), 1.0]) for i in range(5)]
    assert all(r.deviation is None for r in W.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect())


def test_filter_is_needed_and_ends():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    values = np.concatenate([np.linspace(9, 3, 20), np.linspace(2.9, 0.01, 180)])
    v, count = (q * values) @ q.T, [0]

    def times(x):
        count[0] += 1
        return v @ x

    vectors, found, residual = W.leading(times, 200, 20)
    assert np.allclose(found, values[:20], rtol=1e-12) and residual < 1e-12
    assert np.abs(np.abs(np.sum(vectors * q[:, :20], axis=0)) - 1).max() < 1e-12
    assert count[0] < 200


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.op13_whitening(spark, SF).collect(), rows)
