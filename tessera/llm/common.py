"""What the operators share: table access, the shared folder, written tables."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) gets a temporary folder;
    on a cluster, whose executors would not see that, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("tessera.shared.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of the tables that ``written`` made and nobody has discarded, by session.
_WRITTEN: dict[int, list[str]] = {}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors.  ``options`` are the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.setdefault(id(df.sparkSession), []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` made in this session, once their results are no longer needed; their number."""
    paths = _WRITTEN.pop(id(spark), [])
    for path in paths:
        system, base = fs.FileSystem.from_uri(path)
        system.delete_dir(base)
    return len(paths)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc32_text(c: Column) -> Column:
    """CRC-32 of an id written as text."""
    return F.crc32(c.cast("string").cast("binary"))


def pieces(batch, size: int = 256):
    """Slices of an Arrow batch, so that only a few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def by_bytes(batch, column: int, most: int):
    """Slices of an Arrow batch whose texts have at most ``most`` bytes together (one text may have more)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, upto = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end
