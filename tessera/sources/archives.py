"""ZIP archives as a data source: one partition for each archive, members guarded."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_MEMBERS, MAX_BYTES = 10_000, 256 << 20
SCHEMA = "archive string, member string, size long, sha256 string, content binary"


def members(files: DataFrame, max_members: int = MAX_MEMBERS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Members of ``files`` (path, content, as ``binaryFile`` reads them).

    Fails on damaged archives, on members that leave the archive's root and on
    archives over the given limits.
    """

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                import pandas as pd

                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    listed = [i for i in z.infolist() if not i.is_dir()]
                    if len(listed) > max_members or sum(i.file_size for i in listed) > max_bytes:
                        raise ValueError(f"{path} has {len(listed)} members or is too large")
                    for i in listed:
                        name = PurePosixPath(i.filename)
                        if name.is_absolute() or ".." in name.parts:
                            raise ValueError(f"{path}: member {i.filename!r} leaves the archive")
                        data = z.read(i)
                        rows.append((path, str(name), len(data), hashlib.sha256(data).hexdigest(), data))
                yield pd.DataFrame(rows, columns=["archive", "member", "size", "sha256", "content"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` (member, sha256) that are missing or differ: member, problem."""
    got = found.select("member", F.col("sha256").alias("got"))
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("sha256"), "differs")
    return expected.join(got, "member", "left").select("member", problem.alias("problem")).filter("problem is not null")
