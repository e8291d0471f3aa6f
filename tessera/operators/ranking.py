"""Ranks of large groups: range partitions and prefix counts instead of a sort of each group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.streaming.run import written


def ranked(rows: DataFrame, key: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) within ``key`` by ``order``, which must tell rows apart.

    Rows are dealt by ranges of (key, order); within a range their place is that
    of the sorted rows, and the counts of the ranges before are added.  What is
    kept together is a row for each key and range.
    """
    parts = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    placed = written(parts.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "ranked")
    counts = placed.groupBy(key, "_part").agg(F.min("_nth").alias("_low"), F.count("*").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(key).orderBy("_part")) - F.col("_held")
    shifts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), (before - F.col("_low") + 1).alias("_shift"))
    met = placed.join(shifts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return met.withColumn(name, (F.col("_nth") + F.col("_shift")).cast("int")).drop("_part", "_nth", "_key", "_of", "_shift")


def quantiles(rows: DataFrame, key: str, value: str, between: dict[str, float], nearest: dict[str, float] | None = None) -> DataFrame:
    """Exact quantiles of each key: ``between`` interpolates, ``nearest`` takes the value at the nearest rank; ``least`` and ``most`` besides.

    Equal values are counted first.  The counts are dealt by ranges of (key,
    value) and added up along them, and the values whose running counts reach the
    ranks asked for are picked; no key comes together in one task.
    """
    nearest = nearest or {}
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    placed = written(counts.repartitionByRange("_k", "_v").withColumn("_part", F.spark_partition_id()), "quantiles")
    parts = placed.groupBy("_k", "_part").agg(F.sum("_c").alias("_held"))
    order = Window.partitionBy("_k").orderBy("_part")
    shifts = parts.select(F.col("_k").alias("_key"), F.col("_part").alias("_of"), (F.sum("_held").over(order) - F.col("_held")).alias("_before"), F.sum("_held").over(Window.partitionBy("_k")).alias("_n"))
    met = placed.join(shifts, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    # a range of a key at a time
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_k", "_part").orderBy("_v"))
    run = met.select("_k", "_v", "_n", (upto - F.col("_c")).alias("_from"), upto.alias("_to"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_from") <= place) & (place < F.col("_to")), F.col("_v")))

    n, picked, out = F.col("_n"), [], []
    for name, p in between.items():
        low = F.floor((n - 1) * F.lit(p))
        picked += [at(low).alias(f"{name}_low"), at(F.ceil((n - 1) * F.lit(p))).alias(f"{name}_high")]
        share = (F.col("_n") - 1) * F.lit(p)
        a, b = F.col(f"{name}_low").cast("double"), F.col(f"{name}_high").cast("double")
        out.append(F.when(a == b, a).otherwise((F.ceil(share) - share) * a + (share - F.floor(share)) * b).alias(name))
    for name, p in nearest.items():
        picked.append(at(F.greatest(F.ceil(n * F.lit(p)) - 1, F.lit(0))).alias(f"{name}_at"))
        out.append(F.col(f"{name}_at").alias(name))
    found = run.groupBy("_k", "_n").agg(*picked, F.min("_v").alias("least"), F.max("_v").alias("most"))
    return found.select(F.col("_k").alias(key), *out, "least", "most")
