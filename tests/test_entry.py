"""Every registered query with SQL gives what DuckDB gives on the same tables; the others give rows."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tessera.plans import analytics, corpus, dialogue, extra, more, retrieval, streams, web_pages

OWN = {k: m for m in (corpus, retrieval, dialogue, analytics, more, streams, extra, web_pages) for k in m.QUERIES}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, con, name):
    df = OWN[name].QUERIES[name](spark, SF)
    rows = df.collect()
    sql = OWN[name].SQL.get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    mine = Counter(tuple(norm(r[c]) for c in want.columns) for r in rows)
    assert mine == Counter(tuple(map(norm, r)) for r in want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
