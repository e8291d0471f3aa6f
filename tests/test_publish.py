"""Concurrent writers of a versioned table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from tessera.sources.files import Conflict, VersionedTable


def test_two_writers_lose_no_version(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    work = lambda who: [VersionedTable(spark, root).publish(spark.range(who * 100 + i + 1)) for i in range(4)]
    with ThreadPoolExecutor(2) as pool:
        first, second = pool.map(work, (1, 2))
    t = VersionedTable(spark, root)
    assert sorted(first + second) == t.numbers() == list(range(1, 9))
    assert sorted(t.pointer(n)["rows"] for n in t.numbers()) == [101, 102, 103, 104, 201, 202, 203, 204]
    assert t.current().count() == t.pointer(8)["rows"]


def test_a_number_is_given_once(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda i: t._put_if_absent(1, b'{"version": "%d", "rows": 1}' % i), range(8)))
    assert got.count(True) == 1 and t.pointer(1)["version"] == str(got.index(True))


def test_a_publish_based_on_an_old_version_is_a_conflict(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        t.current()
    assert t.publish(spark.range(3), based_on=0) == 1
    with pytest.raises(Conflict, match="1 is current"):
        t.publish(spark.range(4), based_on=0)
    assert t.publish(spark.range(5), based_on=1) == 2 and t.current().count() == 5
