"""An inverted index of chunks: vocabulary, postings, chunk statistics.

Terms are found anywhere inside the words of a field, as a trigram index finds
them, without positions: a term of letters, digits and underscores that occurs
in a text occurs inside one of its words.  So a term meets the vocabulary by its
character n-grams, and the words that hold it lead to their postings.  How often
the term is in a chunk is the sum over these words of the word's count times the
term's occurrences in it.

``grams`` (gram, token) have each word's n-grams; ``postings`` (bucket, token, block,
gaps, counts by field, most) are written in order of their tokens within a file; a posting
block is what a token has in 32 consecutive ids, with the gaps between its chunks and its
largest count.  ``stats`` has the chunks' fields without their texts.  A query reads
the n-grams and words of its terms, then statistics of chunks; never a text.

Texts are shuffled once when the index is built, postings and n-grams never: words that
hold a term are sent to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tessera.streaming.run import scratch

#: What lies between words.
NOT_WORD = r"[^\p{L}\p{N}_]+"
#: Ids of a posting block, and the room for a document's chunks in a posting's key.
BLOCK_BITS, CHUNK_BITS = 5, 40
#: Folders that postings are dealt into.
BUCKETS = 16
#: Characters of text whose words one task counts.
PART_CHARS = 1 << 24
#: Words that are sent to every task at once.
HELD = 500_000
#: How the index is written: it is read often, and takes as much room as the texts.
PACKED = {"compression": "zstd"}
KEYS = ("doc_id", "chunk_index")


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD), lambda w: w != "")


def grams_of(c: Column, size: int) -> Column:
    """The different character n-grams of a string."""
    at = F.sequence(F.lit(1), F.length(c) - (size - 1))
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def occurrences(c: Column, term: Column) -> Column:
    """How often ``term`` is in ``c`` without overlap."""
    return ((F.length(c) - F.length(F.replace(c, term, F.lit("")))) / F.length(term)).cast("long")


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


@F.arrow_udf(ArrayType(LongType()))
def _running(gaps: pa.Array) -> pa.Array:
    """Running sums of each list, in one pass over all."""
    sums, at = np.cumsum(gaps.flatten().to_numpy(zero_copy_only=False)), gaps.offsets.to_numpy()
    at = at - at[0]
    before = np.concatenate([np.zeros(1, np.int64), sums])[at[:-1]]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sums - np.repeat(before, np.diff(at)), pa.int64()))


class ChunkIndex:
    """The tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str, fields: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.root, self.fields, self.buckets = spark, root, fields, buckets

    @property
    def stats(self) -> DataFrame:
        """A row for each chunk: its keys, its fields but the text, and ``trigrams``, the length that scores are normed by."""
        return self.spark.read.parquet(f"{self.root}/stats")

    @property
    def postings(self) -> DataFrame:
        counts = ", ".join(f"n{n} array<int>" for n in range(len(self.fields)))
        return self.spark.read.schema(f"token string, block long, gaps array<long>, {counts}, most int, bucket int").parquet(f"{self.root}/postings")

    @property
    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/grams")

    @classmethod
    def build(cls, chunks: DataFrame, root: str, fields: tuple[str, ...] = ("title", "text"), buckets: int = BUCKETS) -> ChunkIndex:
        """Writes the index of ``chunks`` (doc_id, chunk_index, title, text and more) below ``root``, a folder that does not exist yet.

        Chunks without an id are left out.  A pair (doc_id, chunk_index) names one
        chunk; rows that repeat it are counted together.
        """
        spark = chunks.sparkSession
        self = cls(spark, root, fields, buckets)
        chunks = chunks.filter("doc_id is not null")
        size = lambda f: F.greatest(F.length(f) - 2, F.lit(0))
        chunks.withColumn("trigrams", size("title") + size("text")).drop("text").write.options(**PACKED).parquet(f"{root}/stats")
        parts = max(spark.sparkContext.defaultParallelism, (self.stats.agg(F.sum("trigrams")).first()[0] or 0) // PART_CHARS + 1)
        block, key = F.shiftright("doc_id", BLOCK_BITS), F.shiftleft(F.col("doc_id").bitwiseAND((1 << BLOCK_BITS) - 1), CHUNK_BITS) + F.col("chunk_index")
        # texts are dealt by blocks: both groupings below hold the block, so neither words nor postings are shuffled
        dealt = chunks.select(block.alias("block"), key.alias("key"), *fields).repartition(parts, "block")
        held = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f).alias("value")) for n, f in enumerate(fields)))
        values = dealt.select("block", "key", F.explode_outer(held).alias("h"))
        found = values.select("block", "key", "h.field", F.explode_outer(F.split(F.lower("h.value"), NOT_WORD)).alias("token")).filter("token <> ''")
        each = found.groupBy("token", "block", "key").agg(*(F.count_if(F.col("field") == n).cast("int").alias(f"n{n}") for n in range(len(fields))))
        counts = [f"n{n}" for n in range(len(fields))]
        lists = each.groupBy("token", "block").agg(F.sort_array(F.collect_list(F.struct("key", *counts))).alias("p"), F.max(F.greatest(*counts) if len(counts) > 1 else F.col(counts[0])).alias("most"))
        keys = F.col("p.key")
        # each key minus the one before it; both lists are made once, not once for each element
        gaps = F.zip_with(keys, F.concat(F.array(F.lit(0).cast("long")), F.slice(keys, 1, F.size(keys) - 1)), lambda k, before: k - before)
        rows = lists.select("token", "block", gaps.alias("gaps"), *(F.col(f"p.{c}") for c in counts), "most", _bucket(F.col("token"), buckets).alias("bucket"))
        rows.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").options(**PACKED).parquet(f"{root}/postings")
        tokens = self.postings.select("token").distinct().repartition(parts, "token")
        grams = F.concat(grams_of(F.col("token"), 1), grams_of(F.col("token"), 2), grams_of(F.col("token"), 3))
        tokens.select(F.explode(grams).alias("gram"), "token").write.options(**PACKED).parquet(f"{root}/grams")
        return self

    def holders(self, terms: DataFrame) -> DataFrame:
        """(term, token, times) of the words that hold each of ``terms`` (term), lower-cased terms of letters, digits and underscores."""
        size = F.least(F.length("term"), F.lit(3))
        cut = F.when(size == 3, grams_of(F.col("term"), 3)).when(size == 2, grams_of(F.col("term"), 2)).otherwise(grams_of(F.col("term"), 1))
        asked = terms.select("term").distinct().select("term", F.explode(cut).alias("gram"))
        # the planner does not know how few these are, and would shuffle the n-grams of all words
        sent = F.broadcast if asked.limit(HELD + 1).count() <= HELD else lambda rows: rows
        # a word that holds a term holds its rarest n-gram, so only the words of that one are looked at
        common = self.grams.join(sent(asked.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("words"))
        rarest = asked.join(common, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("words", F.lit(0)).alias("words"), "gram")).alias("r"))
        met = self.grams.join(sent(rarest.select("term", F.col("r.gram").alias("gram"))), "gram")
        return met.filter(F.col("token").contains(F.col("term"))).select("term", "token", occurrences(F.col("token"), F.col("term")).alias("times"))

    def matches(self, terms: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """(term, doc_id, chunk_index, a count by field) of each chunk that holds one of ``terms`` in any field; ``held`` are their holders, if written already."""
        rows = self._posted(self.holders(terms)) if held is None else self._in_rounds(held)
        return rows.groupBy("term", *KEYS).agg(*(F.sum(f).alias(f) for f in self.fields))

    def _posted(self, held: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """A row for each word of ``held`` and chunk that has it, of these ``buckets`` or of all."""
        names = [f"n{n}" for n in range(len(self.fields))]
        postings = self.postings if buckets is None else self.postings.filter(F.col("bucket").isin(buckets))
        met = postings.join(held.withColumn("bucket", _bucket(F.col("token"), self.buckets)), ["bucket", "token"])
        posts = met.select("term", "times", "block", _running("gaps").alias("key"), *names).select("term", "times", "block", F.explode(F.arrays_zip("key", *names)).alias("p"))
        doc = F.shiftleft("block", BLOCK_BITS) + F.shiftright("p.key", CHUNK_BITS)
        return posts.select("term", doc.alias("doc_id"), F.col("p.key").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int").alias("chunk_index"), *((F.col(f"p.{n}") * F.col("times")).alias(f) for n, f in zip(names, self.fields)))

    def _in_rounds(self, held: DataFrame) -> DataFrame:
        """``_posted`` of any number of words: rounds of about ``HELD`` words meet the postings of their buckets, so no posting is shuffled."""
        rounds = -(-held.count() // HELD)
        if rounds <= 1:
            return self._posted(F.broadcast(held))  # HELD rows at most
        parts = self.buckets * -(-rounds // self.buckets)
        rounds, path = (rounds if parts == self.buckets else parts), scratch(self.spark, "posted")
        for n in range(rounds):
            own = list(range(n, parts, rounds))
            some = held.filter(_bucket(F.col("token"), parts).isin(own))
            rows = self._posted(F.broadcast(some), sorted({p % self.buckets for p in own}))
            rows.write.mode("append").options(**PACKED).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
