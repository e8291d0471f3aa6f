"""Signals on arrays: built-in functions where they express it, Arrow-batched NumPy where they do not."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_abs(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size(samples)


def to_pcm16(samples: Column, gain_db: float = 0.0) -> Column:
    """Clipped, scaled by 32767 above zero and 32768 below, rounded half to even."""
    gain = 10 ** (gain_db / 20)

    def one(x):
        y = F.least(F.greatest(x * F.lit(gain), F.lit(-1.0)), F.lit(1.0))
        return F.bround(F.when(y < 0, y * 32768).otherwise(y * 32767)).cast("short")

    return F.transform(samples, one)


def from_pcm16(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.when(x < 0, x / 32768.0).otherwise(x / 32767.0))


def edge_fades(samples: Column, n: int) -> Column:
    """Raised-cosine fades of ``n`` samples at both ends."""
    size = F.size(samples)
    ramp = lambda i: 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * (i + 0.5) / n)
    return F.transform(samples, lambda x, i: x * F.when(i < n, ramp(i)).otherwise(1.0) * F.when(i >= size - n, ramp(size - 1 - i)).otherwise(1.0))


def carry_chunks(payload: Column, size: int) -> Column:
    """A binary cut into pieces of ``size`` bytes, the last shorter."""
    starts = F.when(F.length(payload) > 0, F.sequence(F.lit(0), F.length(payload) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.substring(payload, s + 1, F.lit(size)))


def resample(rate_in: int, rate_out: int):
    """Linear resampling of float arrays, as a pandas UDF."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not len(x):
                return x
            n = max(1, round(len(x) * rate_out / rate_in))
            return np.interp(np.arange(n) * rate_in / rate_out, np.arange(len(x)), np.asarray(x, float)).tolist()

        return series.map(one)

    return run


def trim_quiet(frame: int, above_db: float = 12.0):
    """Trims frames at both ends that are not ``above_db`` over the tenth percentile of frame levels, as a pandas UDF."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(x) < frame:
                return x
            x = np.asarray(x, float)
            level = 10 * np.log10((x[: len(x) // frame * frame].reshape(-1, frame) ** 2).mean(1) + 1e-12)
            loud = np.nonzero(level > np.percentile(level, 10) + above_db)[0]
            return x.tolist() if not len(loud) else x[loud[0] * frame : (loud[-1] + 1) * frame].tolist()

        return series.map(one)

    return run


def polyphase_taps(rate_in: int, rate_out: int, crossings: int = 32, edge: float = 0.92, beta: float = 9.0):
    """(up, down, first offset, taps of each phase): a Kaiser-windowed sinc below both bands' ends, each phase summing to one."""
    import numpy as np

    common = math.gcd(rate_in, rate_out)
    up, down = rate_out // common, rate_in // common
    # the cut in cycles of an input sample, and how far the sinc reaches
    cut = edge * min(1.0, up / down)
    half = math.ceil(crossings / cut)
    offsets = np.arange(-half, half + 1)
    away = np.arange(up)[:, None] / up - offsets[None, :]
    window = np.i0(beta * np.sqrt(np.clip(1 - (away / (half + 1)) ** 2, 0, None))) / np.i0(beta)
    taps = np.sinc(cut * away) * window
    return up, down, -half, taps / taps.sum(1, keepdims=True)


def band_limited(rate_in: int, rate_out: int):
    """Resampling without what the new rate cannot hold, to round(length * out / in) samples, as a pandas UDF.

    A polyphase filter: each output has one of ``up`` sets of taps over the inputs
    around it.  Beyond its ends a signal is silent; null stays null.
    """
    import numpy as np

    up, down, first, taps = polyphase_taps(rate_in, rate_out)

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        def one(x):
            if x is None or not len(x) or up == down:
                return x
            x = np.asarray(x, float)
            n = max(1, round(len(x) * rate_out / rate_in))
            padded = np.concatenate([np.zeros(-first), x, np.zeros(-first + down + 1)])
            out = np.empty(n)
            for at in range(0, n, 8192):
                places = np.arange(at, min(n, at + 8192)) * down
                around = padded[(places // up)[:, None] + np.arange(taps.shape[1])[None, :]]
                out[at : at + 8192] = np.einsum("ij,ij->i", around, taps[places % up])
            return out.tolist()

        return series.map(one)

    return run
