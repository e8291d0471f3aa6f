"""Binary artefacts as files: a data source that writes drafts, puts them in place when all tasks are done, and reads them back.

    df.select("name", "content").write.format("artefacts").mode("append").save("hdfs://.../audio")
"""

from __future__ import annotations

import time
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.sources.zips import safe_name


#: Files that are looked for with one call, and calls at once, when drafts are put in place.
AT_ONCE, CALLS = 1000, 16
#: Times that the folder of drafts is deleted, should a late file of a task keep it from being empty, and seconds between.
DELETIONS, PAUSE = 20, 0.1
#: Entries of the first level that a task reads.
FOLDERS = 128


@dataclass
class Drafts(WriterCommitMessage):
    names: list[tuple[str, str]]


class ArtefactWriter(DataSourceWriter):
    """Rows (name, content).  A task writes drafts under a folder of its attempt; commit moves them to their names, abort deletes the drafts of all."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.drafts = f".drafts-{uuid.uuid4().hex}"
        system, base = self._at()
        system.create_dir(f"{base}/{self.drafts}", recursive=True)

    def _at(self):
        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return system, base

    def write(self, iterator) -> Drafts:
        system, base = self._at()
        # the driver made the folder of the drafts; where it is gone, the job has failed and nothing may be written
        folder, names = f"{base}/{self.drafts}/{TaskContext.get().taskAttemptId()}", []
        system.create_dir(folder, recursive=False)
        for row in iterator:
            draft = f"{folder}/{len(names)}"
            with system.open_output_stream(draft) as out:
                out.write(bytes(row["content"] or b""))
            names.append((draft, safe_name(row["name"])))
        return Drafts(names)

    def commit(self, messages) -> None:
        system, base = self._at()
        names = [n for m in messages if m for n in m.names]
        twice = [n for n, times in Counter(n for _, n in names).items() if times > 1]
        with ThreadPoolExecutor(CALLS) as calls:
            there = []
            if not self.overwrite:
                places = [f"{base}/{n}" for _, n in names]
                found = calls.map(system.get_file_info, [places[i : i + AT_ONCE] for i in range(0, len(places), AT_ONCE)])
                there = [n for (_, n), i in zip(names, (i for batch in found for i in batch)) if i.type != fs.FileType.NotFound]
            if twice or there:
                self.abort(messages)
                raise FileExistsError(f"artefacts {', '.join(sorted([*twice, *there])[:5])} exist already or come twice")
            list(calls.map(lambda folder: system.create_dir(f"{base}/{folder}", recursive=True), {n.rpartition("/")[0] for _, n in names} - {""}))
            list(calls.map(lambda n: system.move(n[0], f"{base}/{n[1]}"), names))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        """Tasks of a failed job may still write: their folder is moved away first, so that they find no place for more."""
        system, base = self._at()
        gone = f"{self.drafts}-gone"
        if system.get_file_info(f"{base}/{self.drafts}").type == fs.FileType.Directory:
            system.move(f"{base}/{self.drafts}", f"{base}/{gone}")
            for left in reversed(range(DELETIONS)):
                try:
                    system.delete_dir(f"{base}/{gone}")
                    break
                except OSError:  # a file that a task was just opening when the folder moved
                    if not left:
                        raise
                    time.sleep(PAUSE)


class ArtefactReader(DataSourceReader):
    """Rows (name, content) of the files below ``path``.  The driver lists its first level alone; tasks list and read the folders."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        entries = sorted(i.path for i in system.get_file_info(fs.FileSelector(base)) if not i.base_name.startswith("."))
        return [InputPartition(entries[i : i + FOLDERS]) for i in range(0, max(len(entries), 1), FOLDERS)]

    def read(self, partition: InputPartition):
        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for entry in system.get_file_info(partition.value):
            inside = system.get_file_info(fs.FileSelector(entry.path, recursive=True)) if entry.type == fs.FileType.Directory else [entry]
            for file in inside:
                name = file.path[len(base.rstrip("/")) + 1 :]
                if file.type == fs.FileType.File and not any(part.startswith(".") for part in name.split("/")):
                    with system.open_input_stream(file.path) as found:
                        yield name, found.read()


class ArtefactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artefacts"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> ArtefactReader:
        return ArtefactReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArtefactWriter:
        return ArtefactWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArtefactSource)
