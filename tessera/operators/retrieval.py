"""Lexical retrieval of many queries over many chunks at once.

Terms of the queries are a small table (checked by ``MAX_TERMS``) that meets an
inverted index built once.  What is grouped and ranked are matches only; texts
are read for the last hits alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.inverted import ChunkIndex
from tessera.rules import demo

MAX_TERMS = 2000
K1, B = 1.2, 0.75


def split_terms(queries=demo.QUERIES, least: int = 3, most: int = 12) -> list[tuple[int, str]]:
    """(query_id, term): the first ``most`` distinct lower-cased terms of at least ``least`` characters."""
    found = []
    for query_id, text in queries:
        words = dict.fromkeys(w for w in re.split(r"[^0-9\w]+", text.lower()) if len(w) >= least)
        found += [(query_id, w) for w in list(words)[:most]]
    if len(found) > MAX_TERMS:
        raise ValueError(f"{len(found)} terms; at most {MAX_TERMS} fit one pass")
    return found


def short_terms(queries=demo.QUERIES, most: int = 8) -> list[tuple[int, str]]:
    """Terms of exactly two characters, which trigrams cannot find: the first ``most`` of each query."""
    found: dict[int, list[str]] = {}
    for q, t in split_terms(queries, 2, 1000):
        if len(t) == 2:
            found.setdefault(q, []).append(t)
    return [(q, t) for q, ts in found.items() for t in ts[:most]]


def term_rows(spark: SparkSession, terms: list[tuple[int, str]]) -> DataFrame:
    """(query_id, term), as a table."""
    return spark.createDataFrame(terms or [(0, "")], "query_id int, term string").filter("term <> ''")


def term_matches(index: ChunkIndex, terms: list[tuple[int, str]], met: DataFrame | None = None) -> DataFrame:
    """query_id, term, doc_id, chunk_index and the counts by field of each match; ``met`` are the terms' matches, if written already."""
    rows = term_rows(index.spark, terms)
    return (index.matches(rows) if met is None else met).join(F.broadcast(rows), "term")  # MAX_TERMS rows at most


def bm25(index: ChunkIndex, terms: list[tuple[int, str]], met: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk_index, query_id, bm25 over trigram lengths of titles and texts; idf at most 0 counts 1e-6."""
    stats = index.stats
    totals = stats.agg(F.count("*").alias("n"), (F.sum("trigrams") / F.count("*")).alias("avg_trigrams"))
    met = (index.matches(term_rows(index.spark, terms)) if met is None else met).withColumn("tf", F.col("title") + F.col("text")).filter("tf > 0")
    df = met.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # a row for each term at most, of which there are MAX_TERMS, and one row of statistics
    idf = df.crossJoin(F.broadcast(totals)).select("term", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"), "avg_trigrams")
    scored = met.join(F.broadcast(idf), "term").join(stats.select("doc_id", "chunk_index", "trigrams"), ["doc_id", "chunk_index"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("trigrams") / F.col("avg_trigrams")))
    owned = scored.select("doc_id", "chunk_index", "term", part.alias("part")).join(F.broadcast(term_rows(index.spark, terms)), "term")
    return owned.groupBy("query_id", "doc_id", "chunk_index").agg(F.sum("part").alias("bm25"))


def top_per_query(scored: DataFrame, k: int, score: str = "bm25", order: tuple[str, ...] = ("doc_id", "chunk_index")) -> DataFrame:
    """The k best of each query, ties by ``order``; adds rank."""
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), *order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def field_score(index: ChunkIndex, terms: list[tuple[int, str]], weights: dict[str, float] = demo.FIELD_WEIGHTS, met: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk_index, query_id, score: min(length, 12) * weight of each field that holds a term, added up for the query's terms."""
    held = sum(F.when(F.col(f) > 0, F.least(F.length("term"), F.lit(12)) * F.lit(w)).otherwise(0.0) for f, w in weights.items())
    return term_matches(index, terms, met).groupBy("query_id", "doc_id", "chunk_index").agg(F.sum(held).alias("score"))


def best_of_each(candidates: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """The best row of each key; on equal scores the one that came first by ``order``."""
    best = candidates.groupBy(*key).agg(F.max_by(F.struct(*candidates.columns), F.struct(F.col(score), -F.col(order))).alias("b"))
    return best.select("b.*")


def keep_domain_or_all(hits: DataFrame, matches: Column) -> DataFrame:
    """Of each query the hits that match its domain, or all of them where none does."""
    flagged = hits.withColumn("in_domain", F.coalesce(matches, F.lit(False)))
    some = flagged.groupBy("query_id").agg(F.bool_or("in_domain").alias("some"))
    return flagged.join(some, "query_id").filter("in_domain or not some").drop("some")


def diversified(scored: DataFrame, group: list[str], k: int = 3, order: tuple[str, ...] = ("path", "chunk_index")) -> DataFrame:
    """Top k of each query by score: the first hit of each evidence group, then the others; adds place.

    Of a group only its k best can be among them, so no query is sorted whole.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    best = [F.col("score").desc(), *order]
    within = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", *group).orderBy(*best))).filter(F.col("nth") <= k)
    w = Window.partitionBy("query_id").orderBy(F.col("nth") > 1, *best)
    return within.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("nth")
