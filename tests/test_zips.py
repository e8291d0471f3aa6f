"""The archive source: partitions, pieces, limits, checksums."""

from __future__ import annotations

import hashlib
import os
import zipfile

import pytest

from tessera.sources import zips as Z


def make(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return str(path)


def read(spark, path, **options):
    spark.dataSource.register(Z.ZipSource)
    return spark.read.format("zip").options(**options).load(str(path))


def test_an_archive_is_read_by_many_tasks_in_pieces(spark, tmp_path):
    blob = os.urandom(50_000)
    members = {f"set/{i}.bin": blob[i * 100 : i * 1000] for i in range(20)} | {"set/big.bin": blob, "set/empty": b""}
    df = read(spark, make(tmp_path / "a.zip", members), split="20000", piece="7000")
    assert df.rdd.getNumPartitions() > 5
    got = {}
    for r in df.orderBy("member", "part").collect():
        assert len(r.content) <= 7000
        got[r.member] = got.get(r.member, b"") + bytes(r.content)
    assert got == {n.removeprefix("set/"): d for n, d in members.items()}
    assert {(r.member, r.sha256) for r in Z.digests(df).collect()} == {(n, hashlib.sha256(d).hexdigest()) for n, d in got.items()}


def test_folders_of_archives(spark, tmp_path):
    for i in range(3):
        make(tmp_path / f"{i}.zip", {f"m{i}.txt": b"x" * i, "other.txt": b"y"})
    assert read(spark, tmp_path).count() == 6 and read(spark, f"file://{tmp_path}").select("archive").distinct().count() == 3


@pytest.mark.parametrize(
    ("members", "options", "message"),
    [
        ({"../x": b"1"}, {}, "leaves the archive"),
        ({"/abs": b"1"}, {}, "leaves the archive"),
        ({"a": b"1", "b": b"2"}, {"maxMembers": "1"}, "2 members"),
        ({"a": b"1" * 100}, {"maxBytes": "99"}, "100 bytes"),
        ({"a": b"0" * 100_000}, {"maxRatio": "50"}, "unpacks to"),
        ({"r/a": b"1", "r/b": b"2"}, {"root": "other"}, "lies in 'r'"),
        ({"r/a": b"1"}, {"required": "a,manifest.json"}, "lacks manifest.json"),
    ],
)
def test_what_is_refused(spark, tmp_path, members, options, message):
    path = make(tmp_path / "a.zip", members)
    with pytest.raises(Exception, match=message):
        read(spark, path, **options).collect()


def test_damage(spark, tmp_path):
    path = make(tmp_path / "a.zip", {"a": os.urandom(2000)}, zipfile.ZIP_STORED)
    data = bytearray(open(path, "rb").read())
    data[500] ^= 255
    (tmp_path / "bad.zip").write_bytes(data)
    with pytest.raises(Exception, match="CRC"):
        read(spark, tmp_path / "bad.zip").collect()
    (tmp_path / "no.zip").write_bytes(b"nothing")
    with pytest.raises(Exception, match="zip file"):
        read(spark, tmp_path / "no.zip").collect()


def test_checksums(spark, tmp_path):
    good = hashlib.sha256(b"one").hexdigest()
    lines = f"{good}  one.txt\n{good} *two.txt\n\n{good}  gone.txt\n"
    df = read(spark, make(tmp_path / "a.zip", {"d/one.txt": b"one", "d/two.txt": b"two", "d/checksums.sha256": lines}))
    assert {(r.member, r.problem) for r in Z.problems(df).collect()} == {("two.txt", "differs"), ("gone.txt", "missing")}
    bad = read(spark, make(tmp_path / "b.zip", {"checksums.sha256": "nonsense\n"}))
    with pytest.raises(Exception, match="no checksum line"):
        Z.problems(bad).collect()
