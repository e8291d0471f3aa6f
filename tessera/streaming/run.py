"""Running a stream over what is there, to the end."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a scratch folder: computed once, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """The table, a file or a folder of files, as a stream (a pattern is matched by either)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def drained(stream: DataFrame, name: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> DataFrame:
    """Writes the append stream into a new folder until its sources are read, and reads the result."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    writer = stream.writeStream.format(fmt).outputMode("append").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).format(fmt).load(f"{out}/data")
