"""ZIP archives as a data source: partitions from the central directory, members read in pieces.

    spark.dataSource.register(ZipSource)
    spark.read.format("zip").option("required", "manifest.json").load("hdfs://.../a.zip")

The driver reads the directories of the archives only.  Members are dealt into
partitions of about ``split`` bytes, so an archive is read by many tasks and a
large member by one that holds a piece of it at a time.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, part int, size long, content binary"
#: Limits of an archive, and bytes of a partition and of a row.
MAX_MEMBERS, MAX_BYTES, MAX_RATIO = 1_000_000, 1 << 40, 1000
SPLIT, PIECE = 32 << 20, 4 << 20


class ArchiveError(ValueError):
    """An archive that is damaged, unsafe, over a limit or without a required member."""


def safe_name(name: str) -> str:
    """A member's name without ``.`` parts; names that leave the archive are errors."""
    path = PurePosixPath(name.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts or (path.parts and path.parts[0].endswith(":")):
        raise ArchiveError(f"member {name!r} leaves the archive")
    return str(path)


def common_root(names: list[str]) -> str:
    """The one folder that all members lie in, or ''."""
    first = {n.split("/", 1)[0] for n in names}
    return first.pop() if len(first) == 1 and all("/" in n for n in names) else ""


def opened(path: str):
    system, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system.open_input_file(base)


def paths_of(path: str) -> list[str]:
    """The archive, or those of a folder, in order of their names."""
    scheme = path.split("://", 1)[0] + "://" if "://" in path else "file://"
    system, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    if system.get_file_info(base).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted(scheme + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))


class Members(InputPartition):
    def __init__(self, archive: str, names: list[tuple[str, str]]):
        super().__init__((archive, names[0][0]))
        self.archive, self.names = archive, names


class ZipReader(DataSourceReader):
    def __init__(self, options):
        get = lambda name, default: int(options.get(name, default))
        self.path = options["path"]
        self.most, self.bytes, self.ratio = get("maxMembers", MAX_MEMBERS), get("maxBytes", MAX_BYTES), get("maxRatio", MAX_RATIO)
        self.split, self.piece = get("split", SPLIT), get("piece", PIECE)
        self.root, self.required = options.get("root"), [n for n in options.get("required", "").split(",") if n]

    def listed(self, archive: str) -> list[tuple[str, str, int]]:
        """(name in the archive, name below its root, size) of its files, checked."""
        try:
            with opened(archive) as handle, zipfile.ZipFile(handle) as z:
                infos = [i for i in z.infolist() if not i.is_dir()]
        except zipfile.BadZipFile as e:
            raise ArchiveError(f"{archive}: {e}") from e
        if len(infos) > self.most or sum(i.file_size for i in infos) > self.bytes:
            raise ArchiveError(f"{archive} has {len(infos)} members of {sum(i.file_size for i in infos)} bytes")
        for i in infos:
            if i.file_size > self.ratio * max(i.compress_size, 1):
                raise ArchiveError(f"{archive}: {i.filename!r} unpacks to {i.file_size} bytes from {i.compress_size}")
        names = [safe_name(i.filename) for i in infos]
        if len(set(names)) < len(names):
            raise ArchiveError(f"{archive} has a member twice")
        root = common_root(names)
        if self.root is not None and root != self.root:
            raise ArchiveError(f"{archive} lies in {root!r}, not in {self.root!r}")
        below = [n[len(root) + 1 :] if root else n for n in names]
        if missing := sorted(set(self.required) - set(below)):
            raise ArchiveError(f"{archive} lacks {', '.join(missing)}")
        return [(i.filename, b, i.file_size) for i, b in zip(infos, below)]

    def partitions(self) -> list[Members]:
        out = []
        for archive in paths_of(self.path):
            names, held = [], 0
            for name, below, size in self.listed(archive):
                if names and held + size > self.split:
                    out.append(Members(archive, names))
                    names, held = [], 0
                names.append((name, below))
                held += size
            if names:
                out.append(Members(archive, names))
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        with opened(partition.archive) as handle, zipfile.ZipFile(handle) as z:
            for name, below in partition.names:
                size = z.getinfo(name).file_size
                try:
                    with z.open(name) as member:
                        part = 0
                        while (data := member.read(self.piece)) or part == 0:
                            yield partition.archive, below, part, size, data
                            part += 1
                except (zipfile.BadZipFile, EOFError) as e:
                    raise ArchiveError(f"{partition.archive}: {name!r}: {e}") from e


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def digests(members: DataFrame) -> DataFrame:
    """archive, member, size, sha256 of members that fit a row (all parts of one come to one row)."""
    whole = members.groupBy("archive", "member", "size").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("p"))
    return whole.select("archive", "member", "size", F.sha2(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["content"])), 256).alias("sha256"))


def checksums(members: DataFrame, name: str = "checksums.sha256") -> DataFrame:
    """(archive, member, sha256) that each archive's checksum file states; a line that is none is an error."""
    text = members.filter(F.col("member") == name).select("archive", F.explode(F.split(F.col("content").cast("string"), "\r?\n")).alias("line")).filter(F.trim("line") != "")
    sound = F.col("line").rlike(r"^[0-9a-f]{64}\s+\S")
    line = F.when(sound, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no checksum line: "), "line")))
    return text.select("archive", F.regexp_extract(line, r"^[0-9a-f]{64}\s+\*?(.*)$", 1).alias("member"), F.substring("line", 1, 64).alias("sha256"))


def problems(members: DataFrame, name: str = "checksums.sha256") -> DataFrame:
    """(archive, member, problem) of members that are stated but missing or that differ."""
    got = digests(members).select("archive", "member", F.col("sha256").alias("got"))
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("sha256"), "differs")
    return checksums(members, name).join(got, ["archive", "member"], "left").select("archive", "member", problem.alias("problem")).filter("problem is not null")
