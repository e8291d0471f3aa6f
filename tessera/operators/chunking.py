"""Documents to keyed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.rules import demo


def catalogue(docs: DataFrame) -> DataFrame:
    """Adds path, title, record_type, source_priority, effective_year and temporal_status; nulls become ''."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select(
        "*", path.alias("path"), T.title_or(F.col("text"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"),
        F.expr(demo.RECORD_TYPE).alias("record_type"), F.expr(demo.PRIORITY).alias("source_priority"), F.expr(demo.YEAR).alias("effective_year"), F.expr(demo.STATUS).alias("temporal_status"),
    )


def chunk_windows(docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """``docs`` with chunk_index, start and the window's text in place of the text."""
    kept = [c for c in docs.columns if c != "text"]
    cut = docs.select(*kept, F.posexplode(T.windows(F.col("text"), size, overlap)).alias("chunk_index", "w"))
    return cut.select(*kept, "chunk_index", F.col("w.start").alias("start"), F.col("w.text").alias("text"))


def part_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id: the path, and ``__part_NN`` from the second chunk on."""
    later = F.concat(F.lit("__part_"), F.lpad((F.col("chunk_index") + 1).cast("string"), 2, "0"))
    return chunks.withColumn("chunk_id", F.concat("path", F.when(F.col("chunk_index") > 0, later).otherwise("")))


def pack_paragraphs(docs: DataFrame, size: int = 900, separator: str = "\n") -> DataFrame:
    """Greedy packing of paragraphs into chunks of at most ``size`` characters (longer paragraphs are cut first).

    The carry of the greedy fill lives in one ``aggregate`` over a document's own
    paragraphs, so documents stay where they are.
    """
    paragraphs = F.filter(F.transform(F.split("text", separator), T.strip), lambda p: F.length(p) > 0)
    cut = F.flatten(F.transform(paragraphs, lambda p: F.transform(T.windows(p, size, 0), lambda w: w["text"])))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(separator), p))
        fits = F.length(joined) <= size
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(p).alias("open")
        )

    packed = F.aggregate(cut, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    kept = [c for c in docs.columns if c != "text"]
    return docs.select(*kept, F.posexplode(packed).alias("chunk_index", "text"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row: n and a digest of the set of (id, size, content digest), whatever the order.

    Digests are added up as whole numbers, so the set is never gathered.
    """
    row = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.length("text").cast("string"), F.sha2(F.col("text"), 256)), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    sums = docs.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """content_hash, n and first_id of texts that several documents have."""
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def ordinal(rows: DataFrame, key: str, order: list[str], name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
