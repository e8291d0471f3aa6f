"""Event and frame series: gaps, runs, sessions, spans, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def gaps(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Adds ``gap``: seconds since the row before; null for the first."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    return rows.withColumn("gap", seconds(ts) - F.lag(seconds(ts)).over(w))


def sessions(rows: DataFrame, key: str, ts: str, tie: str, silence: float) -> DataFrame:
    """Adds ``session``: a gap of at least ``silence`` seconds ends one (session_window would merge equality)."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    cut = F.when(F.coalesce(F.col("gap") >= silence, F.lit(False)), 1).otherwise(0)
    return gaps(rows, key, ts, tie).withColumn("session", F.sum(cut).over(w))


def runs(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Maximal runs of rows with ``flag``: key, run, frames, first and last of order[0]."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("on", F.coalesce(flag, F.lit(False))).withColumn("run", F.sum(F.when(F.col("on"), 0).otherwise(1)).over(w))
    return marked.filter("on").groupBy(key, "run").agg(F.count("*").alias("frames"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def carry_forward(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last value that is not null up to each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def preroll(rows: DataFrame, key: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """Adds count and sum of the last ``n`` rows, the present one included."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("lead_in", F.count(value).over(w)).withColumn("lead_in_sum", F.sum(value).over(w))


def frame_span(k: Column, rate: int, fps: int) -> Column:
    """[start, end) of the samples that frame ``k`` owns, ends rounded half to even."""
    edge = lambda n: F.bround((n * rate).cast("decimal(30,0)") / fps).cast("long")
    return F.struct(edge(k).alias("start"), edge(k + 1).alias("end"))


def interval_matches(samples: DataFrame, spans: DataFrame, t: str, start: str, end: str, width: float) -> DataFrame:
    """Spans with each of their samples at start <= t <= end.

    Both sides meet on time buckets of ``width``: an interval is repeated for
    each bucket it touches, so the join is an equi-join with a residual filter.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    wide = spans.withColumn("bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return wide.join(samples.withColumn("bucket", bucket(t)), "bucket").filter((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("bucket")


def interval_join(samples: DataFrame, spans: DataFrame, t: str, start: str, end: str, width: float) -> DataFrame:
    """Left range join of ``spans`` with the samples at start <= t <= end."""
    met = interval_matches(samples, spans, t, start, end, width)
    missing = spans.join(met.select(*spans.columns).distinct(), spans.columns, "left_anti")
    return met.unionByName(missing, allowMissingColumns=True)


def first_marks(rows: DataFrame, key: str, name: str, at: Column, names: list[str]) -> DataFrame:
    """Wide row of the first mark of each name."""
    return rows.groupBy(key).pivot(name, names).agg(F.min(at))
