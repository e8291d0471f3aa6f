"""Session operators over several batches, against plain folds."""

from __future__ import annotations

import random
import uuid

import pytest

from tessera.streaming import sessions as S

BASE = 1_700_000_000_000


def streamed(spark, tmp_path, processor, batches, live=False):
    """What the processor gives for batches of (session, seq, ms, kind)."""
    folder = tmp_path / uuid.uuid4().hex
    for rows in batches:
        df = spark.createDataFrame(rows, "session long, seq long, ms long, kind string").selectExpr("session", "seq", f"timestamp_millis({BASE} + ms) as at", "kind")
        df.coalesce(1).write.mode("append").parquet(str(folder / "in"))
    source = spark.readStream.schema("session long, seq long, at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    name, parts = f"out_{uuid.uuid4().hex}", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    query = S.run_sessions(source, processor, live).writeStream.format("memory").queryName(name).outputMode("append").trigger(**({"processingTime": "0 seconds"} if live else {"availableNow": True})).option("checkpointLocation", str(folder / "state")).start()
    # with timers of processing time a query never ends by itself
    query.awaitTermination(30) if live else query.awaitTermination()
    query.stop()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    return [tuple(r) for r in spark.table(name).collect()]


def test_half_duplex_drops_audio_while_it_thinks_and_speaks(spark, tmp_path):
    a = [(1, 1, 0, "audio"), (1, 2, 10, "audio"), (1, 3, 20, "utterance"), (2, 1, 0, "utterance"), (2, 2, 5, "audio")]
    b = [(1, 4, 30, "audio"), (1, 5, 40, "reply"), (1, 6, 50, "audio"), (2, 3, 30, "error"), (1, 2, 60, "audio")]
    c = [(1, 7, 60, "done"), (1, 8, 70, "audio"), (1, 9, 80, "reply"), (2, 4, 70, "audio"), (2, 5, 80, "utterance")]
    got = sorted(streamed(spark, tmp_path, S.Sessions(), [a, b, c]))
    assert got == sorted(
        [
            (1, 3, "utterance", 1, "thinking", 2, 0), (1, 2, "late", 1, "thinking", 2, 0), (1, 5, "reply", 1, "speaking", 2, 1), (1, 7, "done", 1, "listening", 2, 2),
            (2, 1, "utterance", 1, "thinking", 0, 0), (2, 3, "error", 1, "listening", 0, 1), (2, 5, "utterance", 2, "thinking", 1, 0),
        ]
    )


def test_idle_sessions_expire(spark, tmp_path):
    a = [(1, 1, 0, "utterance"), (2, 1, 0, "audio")]
    b = [(2, 2, 100, "audio")]
    c = [(2, 3, 2000, "utterance"), (1, 2, 2500, "utterance")]
    got = sorted(streamed(spark, tmp_path, S.Sessions(idle_ms=1000), [a, b, c, [(3, 1, 9000, "audio")]]))
    assert got == sorted([(1, 1, "utterance", 1, "thinking", 0, 0), (1, -1, "expired", 1, "thinking", 0, 0), (2, -1, "expired", 0, "listening", 2, 0), (2, 3, "utterance", 1, "thinking", 0, 0), (1, 2, "utterance", 1, "thinking", 0, 0), (1, -1, "expired", 1, "thinking", 0, 0), (2, -1, "expired", 1, "thinking", 0, 0)])


def fillers(rows, filler, limit, retry, until):
    """A plain fold with a list of what falls due."""
    out, asked, timers, retried = [], None, [], False

    def fire(to):
        nonlocal asked
        while asked and timers and min(timers)[0] <= to:
            at, event = min(timers)
            timers.remove((at, event))
            out.append((asked[0], event, at - asked[1]))
            if event == "timeout":
                asked = None

    for seq, at, kind in rows:
        fire(at - 1)
        if kind == "request":
            asked, timers, retried = (seq, at), [(at + filler, "filler"), (at + limit, "timeout")], False
        elif asked and kind == "exhausted" and not retried:
            retried = True
            timers.append((at + retry, "retry"))
        elif asked and kind in ("chunk", "exhausted", "error"):
            out.append((asked[0], {"chunk": "first", "exhausted": "busy", "error": "error"}[kind], at - asked[1]))
            asked = None
    fire(until)
    return out


@pytest.mark.parametrize("cut", [13, 29])
def test_fillers_and_timeouts_do_not_depend_on_batches(spark, tmp_path, cut):
    rng = random.Random(cut)
    rows, want = {}, []
    for key in range(3):
        at, own = 0, []
        for seq in range(30):
            at += rng.choice([50, 300, 900, 1500, 5000])
            own.append((seq, at, rng.choice(["request", "request", "chunk", "exhausted", "error", "noise"])))
        rows[key] = own
        want += [(key, *x) for x in fillers(own, 1000, 4000, 700, 10**6)]
    flat = sorted((at, key, seq, kind) for key, own in rows.items() for seq, at, kind in own)
    batches = [[(key, seq, at, kind) for at, key, seq, kind in flat[i : i + cut]] for i in range(0, len(flat), cut)]
    got = streamed(spark, tmp_path, S.Fillers(1000, 4000, 700), [*batches, [(99, 0, 10**6 + 10, "noise")]])
    assert sorted(got) == sorted(want)


def test_live_timers_fire(spark, tmp_path):
    rows = [[(1, 1, 0, "request")], [(2, 1, 0, "noise")], [(2, 2, 0, "noise")]]
    assert (1, 1, "timeout", 4000) in streamed(spark, tmp_path, S.Fillers(1000, 4000, 700), rows, live=True)


def test_early_results_are_void_when_speech_resumes(spark, tmp_path):
    kinds = "speech silence silence speech silence silence silence end speech silence end end silence end".split()
    rows = [(1, i, i * 10, k) for i, k in enumerate(kinds)]
    want = [(1, 2, "begun", 3), (1, 3, "void", 3), (1, 5, "begun", 6), (1, 7, "used", 6), (1, 10, "made", 2)]
    for cut in (4, 14):
        assert sorted(streamed(spark, tmp_path, S.EarlyResults(2), [rows[i : i + cut] for i in range(0, len(rows), cut)])) == want
