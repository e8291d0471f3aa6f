"""A crawl over tables of pages and links: depth, budgets, scope and failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import ranked
from tessera.streaming.run import written

KEY = ["category", "url"]


class SeedFailed(ValueError):
    """No seed of a category gave a page."""


def _within(frontier: DataFrame, spent: DataFrame, max_pages: int) -> DataFrame:
    """The rows of the frontier that their category's budget still pays for, those of the smallest URLs; categories that have enough are not ranked."""
    sizes = frontier.groupBy("category").agg(F.count("*").alias("asked")).join(spent, "category", "left")
    left = written(sizes.select("category", "asked", (F.lit(max_pages) - F.coalesce("spent", F.lit(0))).alias("left")), "crawl-budget")
    whole = frontier.join(left.filter("asked <= left").select("category"), "category", "left_semi")
    short = left.filter("asked > left and left > 0").select("category", "left")
    if short.isEmpty():
        return whole
    part = ranked(frontier.join(short, "category"), "category", [F.col("url")], "_place")
    return whole.unionByName(part.filter(F.col("_place") <= F.col("left")).select(*KEY))


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, in_scope: Callable[[Column, Column], Column], max_depth: int, max_pages: int, least_chars: int = 0, strict: bool = True) -> DataFrame:
    """(category, url, depth, final_url, failure): every URL asked for, with the page it led to or why it gave none.

    ``pages`` (url, final_url, chars, error) is what fetching a URL gives, ``links``
    (url, href) has the links of a page by its final URL, ``seeds`` (category, url)
    the beginnings.  A category asks for ``max_pages`` URLs at most, those that fail
    among them, nearest first and then by URL.  ``in_scope(category, url)`` is asked of
    links before they are queued and of the URL that a page was redirected to.
    Failures: ``not found``, ``redirected out of scope``, ``too short`` (fewer than
    ``least_chars``), or the page's own ``error``; their links are not followed.
    With ``strict`` a category none of whose seeds gives a page raises ``SeedFailed``.

    URLs and categories that are null take no part; repeated seeds and links count
    once; of several pages of one URL that of the smallest final URL counts.  Without
    seeds the result is empty.  A hop is two joins and one distinct, all of it written.
    """
    first = F.min(F.struct("final_url", "chars", "error"))
    known = written(pages.filter(F.col("url").isNotNull()).groupBy("url").agg(first.alias("p")).select("url", "p.*", F.lit(True).alias("known")), "crawl-pages")
    hrefs = links.select(F.col("url").alias("final_url"), F.col("href").alias("target")).filter(F.col("target").isNotNull())
    frontier = written(seeds.select(*KEY).dropna().distinct(), "crawl-frontier")
    seen = None
    for depth in range(max_depth + 1):
        if frontier.isEmpty():
            break
        spent = seen.groupBy("category").agg(F.count("*").alias("spent")) if seen is not None else frontier.sparkSession.createDataFrame([], "category string, spent long")
        asked = _within(frontier, spent, max_pages).join(known, "url", "left")
        failure = (
            F.when(F.col("known").isNull(), "not found")
            .when(F.col("error").isNotNull(), F.col("error"))
            .when(~F.coalesce(in_scope(F.col("category"), F.col("final_url")), F.lit(False)), "redirected out of scope")
            .when(F.coalesce("chars", F.lit(0)) < least_chars, "too short")
        )
        visits = written(asked.select(*KEY, F.lit(depth).alias("depth"), "final_url", failure.alias("failure")), "crawl-visits")
        if depth == 0 and strict:
            missing = visits.groupBy("category").agg(F.count_if(F.col("failure").isNull()).alias("good"), F.min("failure").alias("why")).filter("good = 0").orderBy("category").take(10)
            if missing:
                raise SeedFailed("; ".join(f"{r.category}: {r.why}" for r in missing))
        seen = visits if seen is None else seen.unionByName(visits)
        if depth == max_depth:
            break
        found = visits.filter(F.col("failure").isNull()).join(hrefs, "final_url").select("category", F.col("target").alias("url"))
        found = found.filter(F.coalesce(in_scope(F.col("category"), F.col("url")), F.lit(False))).distinct()
        frontier = written(found.join(seen.select(*KEY), KEY, "left_anti"), "crawl-frontier")
    if seen is None:
        return frontier.select(*KEY, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("failure"))
    return seen
