"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are whole numbers x; V is the covariance of all of them.  A block of
directions Q is multiplied by V in passes over the data: each task adds up
X'(XQ) for its centred rows and the sums are added by dimension, so neither V
nor any row reaches the driver, which holds a few blocks of (dimensions x block)
numbers.  A Chebyshev polynomial of V, made by its recurrence from such passes,
damps the directions whose eigenvalues lie below the block's smallest; then
follow QR and Rayleigh-Ritz, until the residuals of the wanted directions are as
small as rounding lets them be.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, written

COMPONENTS = 32
#: A component becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
SEED = 13
#: Damping that a filter aims at, and its highest degree.
DAMPING, MAX_DEGREE = 1e7, 24
#: How much more than the last wanted direction the first one may grow in a filter, lest rounding swamps the block.
CONTRAST = 1e9
#: Residuals, as shares of the largest eigenvalue: surely enough, and enough once they no longer halve.
CERTAIN, ENOUGH = 3e-15, 1e-11
#: Eigenvalues below this share of the largest are rounding.
RANK = 1e-12
MAX_ROUNDS = 60
#: Lanczos steps that bound the spectrum from below.
LANCZOS = 8


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # of each dimension, exact
    components: np.ndarray  # unit columns by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    residual: float  # largest, as a share of the largest eigenvalue
    passes: int


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is not null, not empty and all finite; repeated rows and null ids stay."""
    v = F.col("v")
    sound = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(v.isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _deviations(column: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums)) * n - sums


def _summed(rows: DataFrame, partial, height: int, width: int) -> np.ndarray:
    """The sum over all rows of ``partial(batch)``, matrices of height x width; added by row of the matrix, not on the driver."""

    def run(batches):
        total = None
        for whole in batches:
            for batch in pieces(whole, 4096):
                part = partial(batch.column(0))
                total = part if total is None else total + part
        if total is not None:
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, height * width + 1, width), pa.int32()), pa.array(total.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height), pa.int32()), values], ["i", "y"])

    parts = rows.select("x").mapInArrow(run, "i int, y array<double>")
    found = parts.groupBy("i").agg(*(F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(width))).collect()
    out = np.zeros((height, width))
    for r in found:
        out[r[0]] = r[1:]
    return out


def covariance_times(rows: DataFrame, n: int, sums: np.ndarray, block: np.ndarray) -> np.ndarray:
    """V @ block in one pass."""

    def partial(column):
        c = _deviations(column, n, sums) / n
        return c.T @ (c @ block)

    return _summed(rows, partial, *block.shape) / n


def filtered(times, x: np.ndarray, vx: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of the operator on [low, cut], applied to ``x``; it is 1 at ``top``."""
    half, mid = (cut - low) / 2, (cut + low) / 2
    first = sigma = half / (top - mid)
    before, now = x, (vx - mid * x) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - mid * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def lower_bound(times, d: int, seed: int = SEED) -> float:
    """A bound below the eigenvalues of ``times``: the least Ritz value of a few Lanczos steps less the norm of what they leave over, 0 at least."""
    rng = np.random.default_rng(seed + 1)
    basis, alphas, betas = [], [], []
    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    for _ in range(min(LANCZOS, d)):
        basis.append(v)
        w = times(v[:, None])[:, 0]
        alphas.append(float(v @ w))
        for _ in range(2):
            w = w - sum((b @ w) * b for b in basis)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-12 * abs(alphas[0]):
            break
        v = w / betas[-1]
    least = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))[0]
    return max(0.0, float(least) - betas[-1])


def leading(times, d: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors and eigenvalues, falling, of the symmetric operator ``times`` (d x d, not negative), and their residual."""
    size = min(d, k + max(8, k // 2))
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    best, low = math.inf, lower_bound(times, d, seed) if size < d else 0.0
    for _ in range(MAX_ROUNDS):
        vx = times(x)
        ritz = x.T @ vx
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx, top = x @ turn, vx @ turn, values[0]
        if not top > 0:
            return x[:, :0], values[:0], 0.0
        wanted = min(k, int((values > RANK * top).sum()))
        residual = float(np.linalg.norm(vx[:, :wanted] - x[:, :wanted] * values[:wanted], axis=0).max() / top)
        if residual <= CERTAIN or (residual <= ENOUGH and residual > best / 2):
            return x[:, :wanted], values[:wanted], residual
        best = min(best, residual)
        cut = max(values[-1], top * RANK / 2)
        # as many steps as the last wanted eigenvalue needs to stand out by DAMPING
        floor = low if low < cut else cut / 2
        growth = lambda value: math.acosh(max(1 + 1e-6, 1 + 2 * (value - cut) / (cut - floor)))
        last, first = growth(values[wanted - 1]), growth(top)
        degree = min(MAX_DEGREE, math.ceil(math.acosh(DAMPING) / last), int(math.log(CONTRAST) / max(first - last, 1e-9)))
        x = np.linalg.qr(filtered(times, x, vx, floor, cut, top, max(2, degree)))[0]
    raise RuntimeError(f"residual {best} after {MAX_ROUNDS} rounds")


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of (vec_id, x); None without rows.  Vectors of several lengths are an error."""
    n, least, most = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if least != most:
        raise ValueError(f"vectors of {least} to {most} entries")
    totals = rows.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).collect()
    sums, passes = np.zeros(most, np.int64), 0
    for r in totals:
        sums[r.i] = r.s

    def times(block):
        nonlocal passes
        passes += 1
        return covariance_times(rows, n, sums, block)

    vectors, values, residual = leading(times, most, min(k, most))
    if not len(values):
        return Whitening(n, sums, vectors, values, 0.0, 0.0, residual, passes)
    scaled, r = vectors / np.sqrt(values), len(values)

    def squares(column):
        c = _deviations(column, n, sums) / n
        w = c @ scaled
        return np.vstack([w.T @ w, np.full((1, r), (c * c).sum())])

    found = _summed(rows, squares, r + 1, r) / n
    return Whitening(n, sums, vectors, values, float(found[r, 0]), float(np.abs(found[:r] - np.eye(r)).max()), residual, passes + 1)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row and component.

    ``deviation`` is null where it does not fit a long.
    """
    n, sums, k = model.n, model.sums, len(model.eigenvalues)
    scaled, shares = model.components / np.sqrt(model.eigenvalues), model.eigenvalues / (model.trace or 1.0)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 1024):
                m, d = batch.num_rows, _deviations(batch.column(1), n, sums)
                if float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
                    deviation = pa.array((d * d).sum(1))
                else:
                    exact = (sum(int(c) ** 2 for c in row) for row in d)
                    deviation = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [batch.column(0).take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), deviation.take(each), ((d / n) @ scaled).reshape(-1), np.tile(shares, m), np.full(m * k, model.identity_error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each row's projections on the ``k`` leading components of the covariance, over the roots of their eigenvalues.

    Rows whose vector is null, empty, or holds null or non-finite entries are
    left out, also of the fit.  Repeated rows and rows without an id count and are returned.
    Directions without variance (fewer rows than dimensions, constant entries)
    are no components; a table without any, an empty one included, gives an empty
    result.  Equal eigenvalues leave the choice of their directions open; it is
    the same for all rows.  Vectors of several lengths are an error.  Other
    columns, whatever their names, play no part.
    """
    rows = written(whole_vectors(vectors, id_col, vector_col), "whole-vectors")
    model = fit(rows, k)
    if model is None or not len(model.eigenvalues):
        model, rows = Whitening(1, np.zeros(1, np.int64), np.zeros((1, 0)), np.zeros(0), 0.0, 0.0, 0.0, 0), rows.limit(0)
    return transform(rows, model)
