"""Query text, segments and utterances that SQL cannot express, against literals and plain folds."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from tessera.functions import query_text as Q
from tessera.streaming.stateful import utterance_stream


@pytest.mark.parametrize(
    ("text", "want"),
    [("二〇二六年", "2026年"), ("千九百九十八年", "1998年"), ("二千年の話", "2000年の話"), ("三百年", "三百年"), ("一九四五", "1945"), ("千歳", "千歳"), ("ＡＢ１", "AB1"), (" a\t\tb\r\nc\n\n\n\nd ", "a b\nc\n\nd"), ("", "")],
)
def test_normalized_query(text, want):
    assert Q.normalized_query.func(pd.Series([text]))[0] == want


def utterances(flags, start, end, least, most, lead):
    """A plain fold over all frames."""
    out, at = [], 0
    while at < len(flags):
        run = 0
        while at < len(flags):
            run = run + 1 if flags[at] else 0
            at += 1
            if run >= start:
                break
        if run < start:
            return out
        begin = at - 1
        floor = out[-1][4] if out else 0
        first = max(floor, at - max(lead, start))
        frames, voiced, silent, last = at - first, run, 0, begin
        while frames < most and silent < end and at < len(flags):
            frames, voiced, silent = frames + 1, voiced + flags[at], 0 if flags[at] else silent + 1
            last = at if flags[at] else last
            at += 1
        out.append((first, last, frames, voiced, at, frames < most and voiced >= least))
    return out


def test_utterances_equal_a_fold(spark, tmp_path):
    rng = random.Random(9)
    streams = {k: [int(rng.random() < p) for _ in range(120)] for k, p in enumerate((0.2, 0.5, 0.7, 0.9, 0.0, 1.0))}
    rows = [(k, i, bool(v), i == 119) for k, f in streams.items() for i, v in enumerate(f)]
    spark.createDataFrame(rows, "k long, i long, on boolean, ends boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k long, i long, on boolean, ends boolean").parquet(str(tmp_path / "in"))
    out = utterance_stream(source, "k", "i", "on", "ends", 2, 3, 3, 40, 4)
    query = out.writeStream.format("memory").queryName("utterances").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("utterances").collect())
    want = sorted((k, *u[:4]) for k, f in streams.items() for u in utterances(f, 2, 3, 3, 40, 4) if u[5])
    assert got == want
