"""Quality and latency metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import quantiles


def latency_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank and interpolated p95, median, p90, min, max of each group."""
    return quantiles(rows, key, value, {"p95": 0.95, "p50": 0.5, "p90": 0.9}, {"p95_rank": 0.95})


def counts_with_zeros(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of each value of ``dimension``, those without rows included."""
    return dimension.join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def mean_reaches(value: Column, bound: float) -> Column:
    """Whether the mean of a group is at least ``bound``, whatever the order of its rows.

    Sums of doubles depend on the order, so a mean that lies on the bound came out
    on either side.  Values are added as decimals of 12 places; groups with
    values from 10^12 on or without a number are judged by their plain mean.
    """
    plain = F.abs(value) < 1e12
    whole = F.sum(F.when(plain, value).otherwise(0.0).cast("decimal(28,12)"))
    least = F.count(value).cast("decimal(20,0)") * F.lit(bound).cast("decimal(14,4)")
    return F.when(F.bool_and(plain), whole >= least).otherwise(F.avg(value) >= bound)


def bootstrap_means(rows: DataFrame, key: str, value: str, resamples: int = 200, seed: int = 7) -> DataFrame:
    """95 % interval of the mean of each group by the Poisson bootstrap, which needs no group in one place.

    Each row enters each resample with a Poisson(1) weight drawn from a hash of
    its key and the resample's number.
    """
    cuts = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582]
    numbered = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.pmod(F.xxhash64(F.lit(seed), "b", *rows.columns), F.lit(1 << 30)) / float(1 << 30)
    weight = sum((u >= c).cast("int") for c in cuts)
    means = numbered.withColumn("w", weight).groupBy(key, "b").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias("mean"))
    return means.groupBy(key).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
