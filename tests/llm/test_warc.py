from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tessera.llm import queries, warc
from tessera.llm.common import shared_dir


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        revisit = to is not None and page_id is not None and page_id > to
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/", "x" * 100), (3, "http://b/", "x" * 100), (9, None, "x" * 100), (3, "http://b/", "x" * 100), (4, "http://c/", "y" * 99), (6, "http://c/\r\nEvil: 1", "y" * 99), (7, "http://é/", None), (8, "", ""),
    (None, "http://n/", "x" * 100), (10, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n é" * 500), (11, "u", "z" * 3_000_000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, digest string")
    got = warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_empty(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 20])
def test_each_record_is_read_once_however_it_is_cut(spark, split):
    pages = spark.createDataFrame([(i, f"http://p/{i}", f"page {i} " * (i % 40)) for i in range(60)], "page_id long, url string, html string").coalesce(2)
    files = warc.write(warc.deduplicated(pages), f"{shared_dir(spark)}/cut-{split}")
    whole = files.filter("bytes > 0")
    if split == 1:
        whole = whole.orderBy("bytes").limit(1)
        want = whole.first()["records"]
        small = warc.read(whole.select("path", F.least("bytes", F.lit(400)).alias("bytes")), split)
        assert small.count() <= want
        return
    rows = warc.read(whole, split).collect()
    assert sorted(r.page_id for r in rows) == list(range(60))
    assert all(r.record_type == "revisit" or bytes(r.payload).decode() == f"page {r.page_id} " * (r.page_id % 40) for r in rows)


def test_archives_are_plain_gzip(spark):
    pages = spark.createDataFrame([(1, "http://p/", "body of it")], "page_id long, url string, html string")
    path = warc.write(warc.deduplicated(pages), f"{shared_dir(spark)}/plain").first()["path"]
    data = gzip.open(path.removeprefix("file://")).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\n\r\nbody of it\r\n\r\n" in data


class Handle:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        return self.data[self.at : self.at + n]


def in_ranges(data, cuts):
    edges = [0, *cuts, len(data)]
    return [x for a, b in zip(edges, edges[1:]) for x in warc.records_in(warc._Source(Handle(data), len(data)), a, b)]


def test_bytes_that_are_no_record_are_told_once():
    one = [warc.member(warc.record(i, "u", b"p" * i, "d", None)) for i in range(5)]
    noise = b"\x1f\x8b\x08junk\x1f\x8b" + gzip.compress(b"not an archive record")
    data = noise + one[0] + noise.join(one[1:]) + b"\x1f\x8b\x08"
    for cut in (0, 10, len(noise), len(noise) + 3, len(data) // 2, len(data)):
        got = in_ranges(data, [cut])
        assert sum(raw is not None for _, raw in got) == 5 and sum(raw is None for _, raw in got) == 5
    clean = b"".join(one)
    for cuts in ([], [1], [len(one[0])], [len(one[0]) + 1, len(clean) - 1]):
        assert [raw is None for _, raw in in_ranges(clean, cuts)] == [False] * 5


def test_damage_is_an_error_or_a_row(spark, tmp_path):
    one = [warc.member(warc.record(i, "u", b"some payload %d" % i, hashlib.sha256(b"some payload %d" % i).hexdigest(), None)) for i in range(6)]
    broken = bytearray(one[3])
    broken[len(broken) // 2] ^= 255
    for name, data, kept in (("middle", b"".join(one[:3]) + bytes(broken) + b"".join(one[4:]), 5), ("cut", b"".join(one)[:-7], 5), ("first", bytes(broken) + one[1], 1)):
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(data)
        files = spark.createDataFrame([(f"file://{path}", len(data))], "path string, bytes long")
        for split in (50, 1 << 20):
            rows = warc.read(files, split, damaged="row").collect()
            assert sum(r.record_type == "response" for r in rows) == kept and sum(r.record_type == "damaged" for r in rows) == 1
        with pytest.raises(Exception, match="damaged"):
            warc.read(files).collect()


def test_records_of_other_writers():
    def raw(*lines, payload=b"abc"):
        return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(payload)}"]).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"

    info = warc.parse(raw("warc-type: WARCINFO", "WARC-Record-ID: <urn:uuid:1>"))
    assert (info["record_type"], info["page_id"], info["record_id"], info["url"], info["payload_bytes"]) == ("warcinfo", None, "<urn:uuid:1>", None, 3)
    plain = warc.parse(raw("WARC-Type: response", "WARC-Target-URI: http://a/", " folded", "WARC-Payload-Digest: sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"))
    assert plain["url"] == "http://a/ folded" and plain["payload"] == b"abc" and plain["payload_digest"] == hashlib.sha256(b"abc").hexdigest()
    assert warc.parse(raw("WARC-Type: resource", "WARC-Payload-Digest: sha1:a9993e364706816aba3e25717850c26c9cd0d89d"))["record_type"] == "resource"
    again = warc.parse(raw("WARC-Type: revisit", "WARC-Refers-To: <urn:uuid:7>", "WARC-Payload-Digest: sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5", payload=b""))
    assert (again["payload_bytes"], again["payload_digest"], again["refers_to"]) == (None, None, None)
    assert warc.parse(raw("WARC-Type: response", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:AAAA"))["payload_bytes"] == 3
    for bad in (raw("WARC-Type: response", "WARC-Payload-Digest: sha256:" + "0" * 64), raw("WARC-Type: response")[:-6]):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op2_warc(spark, SF).collect()), key=str) == expected(rows)
