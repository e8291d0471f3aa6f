"""Breadth-first reach over a link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.streaming.run import written


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): nodes reached from ``seeds`` (node) over ``edges`` (src, dst) in at most ``max_depth`` hops.

    A hop joins the frontier with the edges and leaves out what has been seen;
    each is written, so that none is computed again.
    """
    seen = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "crawl")
    frontier = seen
    for depth in range(1, max_depth + 1):
        nxt = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = written(nxt.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "crawl")
        seen = seen.unionByName(frontier)
    return seen
