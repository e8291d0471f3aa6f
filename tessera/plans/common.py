"""Shared pieces of the registered queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import chunking
from tessera.rules import demo
from tessera.session import table

SIZE, OVERLAP = 900, 120


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_windows(chunking.catalogue(documents(spark, sf_dir)), SIZE, OVERLAP)


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQL_CATALOGUE = f"""cat AS (SELECT *, source || '/' || lang || '/' || doc_id AS path,
    CASE WHEN {STRIP.format("regexp_extract(text, '(?m)^[ \t]*#+[ \t]*(.+)$', 1)")} <> '' THEN {STRIP.format("regexp_extract(text, '(?m)^[ \t]*#+[ \t]*(.+)$', 1)")} ELSE 'doc ' || doc_id END AS title,
    {demo.RECORD_TYPE} AS record_type, {demo.PRIORITY} AS source_priority, {demo.YEAR} AS effective_year, {demo.STATUS} AS temporal_status
  FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents))"""
SQL_CHUNKS = f"""{SQL_CATALOGUE},
  cut AS (SELECT * EXCLUDE (text), s AS start, {STRIP.format(f"substr(text, (s + 1)::BIGINT, {SIZE})")} AS text
    FROM (SELECT *, unnest(range(0, length(text), {SIZE - OVERLAP})) AS s FROM cat)),
  chunks AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_index FROM cut WHERE length(text) > 0)"""


def values(rows, names: str) -> str:
    """Rows of numbers, strings and nulls as a SQL table."""
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{names} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}))"
