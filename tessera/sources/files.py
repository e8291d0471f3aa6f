"""Text, JSON-lines and key-value files; versioned tables."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """(path, size, text) of all files below ``path`` with one of the suffixes; faulty UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s)
    return files.filter(wanted).select("path", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of JSON-lines files with ``_problem``: null, 'malformed' or the first required field that is missing."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    problem = F.when(F.col("_corrupt").isNotNull(), "malformed")
    for name in required:
        problem = problem.when(F.col(name).isNull(), name)
    return rows.withColumn("_problem", problem).drop("_corrupt")


def env_lines(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of ``KEY=value`` lines; ``export``, quotes, comments and blank lines are understood."""
    pattern = r"""^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"""
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("value"))
    return rows.filter("key <> ''").select("key", F.regexp_replace("value", r"""^(["'])(.*)\1$""", "$2").alias("value"))


class Conflict(Exception):
    """Another writer has published since the version that a publish was based on."""


class VersionedTable:
    """A folder of versions and numbered pointers, the highest of which is current.

    A version is written whole and verified before its pointer is put, so readers
    see the old version until then, and a failed build changes nothing.  A pointer
    is put only where none is: of two writers that reach for a number one gets it,
    and the other takes the next.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def numbers(self) -> list[int]:
        """The numbers of all pointers, ascending."""
        fs, folder = self._hadoop(f"{self.root}/pointers")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"[0-9]{20}\.json", n))

    def pointer(self, number: int) -> dict:
        fs, path = self._hadoop(f"{self.root}/pointers/{number:020d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def current(self) -> DataFrame:
        numbers = self.numbers()
        if not numbers:
            raise FileNotFoundError(f"{self.root} has no version")
        return self.spark.read.parquet(f"{self.root}/data/{self.pointer(numbers[-1])['version']}")

    def _put_if_absent(self, number: int, content: bytes) -> bool:
        """Does the pointer stand now, and is it ours?"""
        fs, path = self._hadoop(f"{self.root}/pointers/{number:020d}.json")
        fs.mkdirs(path.getParent())
        if fs.getScheme() == "file":
            # a link is made in one step or not at all, with the content in it
            target = path.toUri().getPath()
            draft = f"{target}.{uuid.uuid4().hex}"
            with open(draft, "wb") as out:
                out.write(content)
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(content))
        out.close()
        return True

    def publish(self, df: DataFrame, verify=lambda written: written.count() > 0, based_on: int | None = None, tries: int = 100) -> int:
        """Writes, verifies and publishes a version; its number.

        With ``based_on`` (0: nothing) it is a ``Conflict`` if another number is
        current when the pointer is put.
        """
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{version}")
        written = self.spark.read.parquet(f"{self.root}/data/{version}")
        if not verify(written):
            raise ValueError("the new version does not verify; the current one stays")
        content = json.dumps({"version": version, "rows": written.count()}).encode()
        for _ in range(tries):
            last = (self.numbers() or [0])[-1]
            if based_on is not None and last != based_on:
                raise Conflict(f"based on {based_on}, but {last} is current")
            if self._put_if_absent(last + 1, content):
                return last + 1
        raise Conflict(f"no free number in {tries} tries")
