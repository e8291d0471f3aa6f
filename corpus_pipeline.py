"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_copies, packing, quality, toxicity
from tessera.llm.common import table, written
from tessera.llm.queries import DOMAIN, mixing_weights, tokenizer_path, toxic_labels

#: Tokens asked for, in hundredths of what the stage gets; leaves that hold too little repeat up to MAX_EPOCHS times.
MIX_PERCENT = 100
MIX_EPOCHS = 2


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not toxic.  Each is judged by its own text: null and repeated ids, null, empty and long texts and other columns stay as they are."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, toxic_labels(spark, sf_dir)))


def without_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of good quality, judged by their own texts as above."""
    return quality.drop_poor(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8 or more), the one with the smallest id; null and empty texts are copies of each other."""
    return near_copies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is repeated for each epoch that takes it; the one with which a leaf's budget ends is cut to its first tokens.

    Documents without words are never taken; rows with null or repeated ids are
    documents of their own, and null languages and sources are leaves.
    """
    return mixing.mixed_texts(docs, F.expr(DOMAIN), mixing_weights(), MIX_PERCENT, MIX_EPOCHS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row: where it lies in which sequence.  Null and empty texts are the single id 0."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", without_toxic), ("quality", without_poor), ("near_duplicates", one_of_each), ("mixing", mixed), ("packing", packed)]

#: Models, fingerprints and the genetic algorithm have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of ``documents``, each written and read again; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
