"""WARC archives: a writer of gzip members and a splittable reader.

Writing: each task streams its rows into one archive, a gzip member for each
record, under a name of its own attempt; the table of written files is committed
by Spark, so a lost or repeated task leaves nothing that is read.

Reading: archives are cut into byte ranges.  A task scans its range for the gzip
magic, validates each candidate by inflating and decoding a WARC header, and
owns the records that start inside its range, reading past its end to finish the
last one.  No index is needed.  Where no member follows the one before, the
archive is damaged: that is an error, or a row of its own if the caller wants to
read on.  Records of other writers are read by the same rules: header names in
any case, folded lines, any record type.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pieces, shared_dir, written

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
SPLIT_BYTES = 8 << 20
#: Tasks of a reading stage, at most; beyond it a task reads several ranges.
MAX_TASKS = 100_000
_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers only, which name digest and length of the full payload."""
    kind = "response" if refers_to is None else "revisit"
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str):
    def run(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        system, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
        count = size = 0
        with system.open_output_stream(path, compression=None) as out:
            for whole in _chain(first, batches):
                for batch in pieces(whole):
                    for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                        data = member(record(page_id, url, payload or b"", digest, refers))
                        out.write(data)
                        count, size = count + 1, size + len(data)
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{path.rpartition('/')[2]}", "records": count, "bytes": size}])

    return run


def _chain(first, rest):
    yield first
    yield from rest


def deduplicated(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to of every row of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``min_revisit`` bytes the one with the smallest
    page_id is kept in full.  Only ids and digests are grouped; payloads meet
    their reference by page, so a payload with many copies stays spread out.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    seen = rows.filter(F.length("payload") >= min_revisit).select("page_id", "digest").filter("page_id is not null")
    least = seen.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).filter("last_id > first_id")
    refers = seen.distinct().join(least, "digest").filter("page_id > first_id").select("page_id", "digest", F.col("first_id").alias("refers_to"))
    return rows.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``records`` (as ``deduplicated`` gives them) and returns path, records, bytes of each archive."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    return written(records.mapInArrow(_writer(folder), "path string, records long, bytes long"), "warc-files")


class _Source:
    """Bytes of a file from anywhere, read forward in blocks."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.data = handle, size, 0, b""

    def window(self, start: int, length: int) -> bytes:
        """``length`` bytes from ``start``, fewer at the end of the file."""
        if start < self.at or start > self.at + len(self.data):
            self.at, self.data = start, b""
        elif start > self.at and len(self.data) > 4 * _BLOCK:
            self.data, self.at = self.data[start - self.at :], start
        need = start + length - self.at - len(self.data)
        if need > 0 and self.at + len(self.data) < self.size:
            self.handle.seek(self.at + len(self.data))
            self.data += self.handle.read(max(need, _BLOCK))
        return self.data[start - self.at : start - self.at + length]


def _inflate(source: _Source, start: int, limit: int | None = None):
    """(content, end) of the gzip member at ``start``; None if there is none or, within ``limit``, no more than its beginning is wanted."""
    opened, at, out = zlib.decompressobj(31), start, []
    try:
        while not opened.eof:
            block = source.window(at, _BLOCK if limit is None else 1024)
            if not block:
                return None
            out.append(opened.decompress(block))
            at += len(block)
            if limit is not None and sum(map(len, out)) >= limit:
                return b"".join(out), at
    except zlib.error:
        return None
    return b"".join(out), at - len(opened.unused_data)


def _member_at(source: _Source, at: int) -> bool:
    """Does a gzip member that begins like a WARC record start here?"""
    if source.window(at, len(_MAGIC)) != _MAGIC:
        return False
    peek = _inflate(source, at, 16)
    return peek is not None and peek[0].startswith(b"WARC/1.")


def records_in(source: _Source, start: int, end: int):
    """(offset, raw record) of each gzip member that starts in [start, end).

    The raw record is None where the archive is damaged: at its beginning, or
    where a member of this range ends, and no whole member follows.
    """
    at, expected = start, start == 0 < end
    while at < source.size and (at < end or expected):
        whole = _inflate(source, at) if _member_at(source, at) else None
        if whole is not None:
            if at >= end:
                return
            yield at, whole[0]
            at, expected = whole[1], True
            continue
        if expected:
            yield at, None
            expected = False
            if at >= end:
                return
        head = source.window(at, _BLOCK)
        found = head.find(_MAGIC, 1)
        # the magic may lie across two blocks
        at += found if found > 0 else max(len(head) - 2, 1)


def headers(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, names in lower case; lines that begin with white space go on with the one before."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def _page_number(value: str | None) -> int | None:
    """The page of a record id that this module wrote; others have none."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found.group(1)) if found else None


def _matches(payload: bytes, stated: str) -> bool:
    """Does a payload have the stated digest?  Names and encodings that are not known are not judged."""
    name, colon, value = stated.partition(":")
    name = name.lower()
    if not colon or name not in ("sha1", "sha256", "md5"):
        return True
    digest = hashlib.new(name, payload, usedforsecurity=False)
    known = {len(digest.hexdigest()): digest.hexdigest(), len(b32 := base64.b32encode(digest.digest()).decode().rstrip("=").lower()): b32}
    text = value.strip().rstrip("=").lower()
    return known.get(len(text), text) == text


def parse(raw: bytes) -> dict:
    """A record: page_id (if it is one of this writer's), record_id, url, payload, payload_bytes, payload_digest (SHA-256), record_type, refers_to.

    Length and digest of a revisit are those that it states of the full payload,
    null where it states none or another kind of digest.
    """
    head, gap, body = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    kind, name = fields.get("warc-type", "unknown").lower(), fields.get("warc-record-id")
    length = fields.get("content-length", "")
    payload = body[: int(length)] if length.isdigit() else body.removesuffix(b"\r\n\r\n")
    if not gap or (length.isdigit() and len(payload) < int(length)):
        raise ValueError(f"record {name} ends before its stated length")
    stated = fields.get("warc-payload-digest", "")
    if kind == "response" and fields.get("content-type", "").lower().startswith("application/http"):
        stated = ""  # digests of these leave out the protocol's head
    if kind != "revisit" and not _matches(payload, stated):
        raise ValueError(f"payload of {name} does not match its digest")
    if kind == "revisit":
        size, digest = fields.get("warc-payload-length"), stated.removeprefix("sha256:") if stated.startswith("sha256:") else None
        size = int(size) if size and size.isdigit() else None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return {
        "page_id": _page_number(name), "record_id": name, "url": fields.get("warc-target-uri"), "payload": payload, "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": _page_number(fields.get("warc-refers-to")),
    }


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64()),
])
READ = "page_id long, record_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long"


def _reader(with_payload: bool, damaged: str):
    def one(path: str, offset: int, raw: bytes | None) -> dict:
        try:
            if raw is None:
                raise ValueError("no whole member")
            row = parse(raw)
        except ValueError as e:
            if damaged == "raise":
                raise ValueError(f"{path} is damaged at byte {offset}: {e}") from e
            row = dict.fromkeys(_SCHEMA.names) | {"record_type": "damaged"}
        if not with_payload:
            row["payload"] = None
        return row | {"path": path, "offset": offset}

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(path) as handle:
                    rows, size = [], 0
                    for offset, raw in records_in(_Source(handle, handle.size()), row["start"], row["end"]):
                        rows.append(one(row["path"], offset, raw))
                        size += len(raw or b"")
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True, damaged: str = "raise") -> DataFrame:
    """The records (``READ``) of archives (path, bytes), each range of ``split_bytes`` a row of work.

    A place where an archive is damaged is an error, or with ``damaged="row"`` a
    row of record_type 'damaged' with its path and offset; reading goes on at
    the next whole member.
    """
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    # a row here stands for megabytes, so the number of tasks is given: rows this small would be merged into one
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(min(int(tasks), MAX_TASKS)).mapInArrow(_reader(with_payload, damaged), READ)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes every row of ``pages`` as a record into the shared folder and reads the archives back.

    Null html is an empty payload and a null URL an empty one; null ids come back
    null and neither refer nor are referred to; repeated rows are each written,
    and those of the smallest id are each a response.  Payloads of any length
    are one record.  Other columns, whatever their names, play no part.  An empty
    table gives no archive and no row.
    """
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read(write(deduplicated(pages), folder), with_payload=False)
