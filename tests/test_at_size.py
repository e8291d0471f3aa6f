"""Steps whose work must not grow with the square of their input, and results that must not depend on the order of rows."""

from __future__ import annotations

import datetime
import re
import time

from pyspark.sql import functions as F

from tessera.operators.inverted import ChunkIndex
from tessera.plans import analytics, extra
from tessera.sources import artefacts


def test_orders_of_a_day_meet_events_once(spark, tmp_path):
    """Joined rows grow with the events, not with events times orders."""
    start = datetime.datetime(2024, 1, 1)
    spark.range(400).select("id", F.timestamp_seconds(F.unix_seconds(F.lit(start)) + F.col("id") * 30).cast("timestamp_ntz").alias("ts"), F.col("id").cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1000).select(F.col("id").alias("o_orderkey"), F.timestamp_seconds(F.unix_seconds(F.lit(start)) + (F.col("id") % 2) * 86400).cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    rows = analytics.telemetry_range_join(spark, str(tmp_path))
    got = rows.collect()
    assert len(got) == 1000 and {(r.o_orderkey % 2, r.n, r.mean_value, r.peak) for r in got} == {(0, 121, 60.0, 120.0), (1, 1, 399.0, 399.0)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate explode.*\n.*Aggregate \[start", plan)


def test_mean_on_the_bound_whatever_the_order(spark, tmp_path):
    """Exact means of 50 are reached in every order of the rows."""
    values = [[0.1] * 10 + [99.9] * 10, [99.9] * 10 + [0.1] * 10, [33.3, 66.7] * 7, [0.7, 0.1, 149.2], [49.99, 50.0]]
    rows = [(u, i, v) for u, vs in enumerate(values) for i, v in enumerate(vs)]
    day = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts")
    spark.createDataFrame(rows, "user_id long, event_id long, value double").coalesce(1).select("*", day).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.speech for r in analytics.energy_vad(spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False}


def test_dates_of_all_orders_are_read(spark, tmp_path):
    """A row for each order, those of one day and those without a date included."""
    rows = [(1, "1996-01-01 00:00:00"), (2, "1996-01-01 00:00:00"), (3, "1997-04-19 00:00:00"), (4, None)]
    spark.createDataFrame(rows, "o_orderkey long, d string").select("o_orderkey", F.col("d").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.spoken for r in extra.spoken_dates(spark, str(tmp_path)).collect()}
    assert got == {1: "せんきゅうひゃくきゅうじゅうろくねんいちがつ ついたち", 2: "せんきゅうひゃくきゅうじゅうろくねんいちがつ ついたち", 3: "せんきゅうひゃくきゅうじゅうななねんしがつじゅうくにち", 4: None}


def test_many_artefacts_are_put_in_place_in_linear_time(spark, tmp_path):
    """The check for names that come twice sorted all names once for each name."""
    artefacts.register(spark)
    writer = artefacts.ArtefactWriter({"path": str(tmp_path)}, False)
    drafts = tmp_path / writer.drafts / "0"
    drafts.mkdir(parents=True)
    names = [(str(drafts / str(i)), f"{i % 300}/turn-{i}.wav") for i in range(12000)]
    for place, _ in names:
        open(place, "wb").close()
    start = time.monotonic()
    writer.commit([artefacts.Drafts(names)])
    assert time.monotonic() - start < 12
    assert {r.name for r in spark.read.format("artefacts").load(str(tmp_path)).collect()} == {n for _, n in names}


def test_long_documents_are_indexed_and_found_in_linear_time(spark, tmp_path):
    """A word's list within a block was walked once for each of its entries, when it was written and when it was read."""
    n = 20000
    chunks = spark.range(0, n, 1, 2).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), F.lit("t").alias("title"), F.concat(F.lit("word w"), F.col("id") % 3).alias("text"))
    start = time.monotonic()
    index = ChunkIndex.build(chunks, f"file://{tmp_path}/i", ("title", "text"), 2)
    rows = index.matches(spark.createDataFrame([("ord",), ("w1",)], "term string")).collect()
    assert time.monotonic() - start < 40
    assert {(r.term, r.chunk_index, r.doc_id, r.text) for r in rows} == {("ord", i, 7, 1) for i in range(n)} | {("w1", i, 7, 1) for i in range(1, n, 3)}
