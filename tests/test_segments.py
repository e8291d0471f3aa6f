"""The segment scanner over every cut of its input, against a plain expression and pairs."""

from __future__ import annotations

import random
import re

import pytest

from tessera.functions.segments import REPLY, Rules, Segmenter
from tessera.streaming.stateful import segment_stream

WIDE = Rules(soft=1 << 20, hard=1 << 20, spaces=True)
#: A full stop ends unless another is beside it or letters are on both sides; ends take closers, spaces and ends with them.
SENTENCES = re.compile(r"(?:[^。！？!?\n.]|\.\.+|(?<=[A-Za-z0-9])(?<!\.)\.(?=[A-Za-z0-9]))*(?:(?:[。！？!?\n]|(?<!\.)\.(?!\.))[.。！？!?\n」』）】)\"'”’ ]*|$)", re.S)


def fed(rules, pieces):
    s = Segmenter(rules)
    return [x for p in pieces for x in s.push(p)] + s.flush()


def cuts(text, rng):
    yield [text]
    yield list(text)
    for at in range(1, len(text)):
        yield [text[:at], text[at:]]
    for _ in range(5):
        at, pieces = 0, []
        while at < len(text):
            n = rng.randrange(1, 9)
            pieces.append(text[at : at + n])
            at += n
        yield pieces


@pytest.mark.parametrize("rules", [Rules(), Rules(soft=6, hard=10, least=2), Rules(soft=12, hard=20, spaces=True), REPLY, Rules(opening=3, soft=9, hard=30)])
def test_every_cut_gives_the_same(rules):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice('ab1 ,.。、」\n!"é文') for _ in range(rng.randrange(60)))
        whole = fed(rules, [text])
        assert all(fed(rules, pieces) == whole for pieces in cuts(text, rng))
        assert [c for x in whole for c in x if c.isalnum()] == [c for c in text if c.isalnum()]
        assert all(len(x) <= rules.hard + 1 for x in whole if not re.search(r"[。！？!?\n.]", x))


def test_sentences_are_those_of_the_expression():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice("ab1 ..。」\n!x") for _ in range(rng.randrange(40)))
        want = [m.group() for m in SENTENCES.finditer(text) if any(c.isalnum() for c in m.group())]
        assert fed(WIDE, [text]) == want, text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It is 1.5 now. Then", ["It is 1.5 now.", "Then"]),
        ("「はい。」と言う", ["「はい。」", "と言う"]),
        ("He said “Thank you.” Then we started.", ["He said “Thank you.”", "Then we started."]),
        ("言う... まだ", ["言う... まだ"]),
        ("Cost: 250,000 in all, and then the rest of it follows", ["Cost: 250,000 in all, and then the rest", "of it follows"]),
        ("x" * 90, ["x" * 80, "x" * 10]),
        ("?! ... \n", []),
        ("Done. 4", ["Done.", "4"]),
    ],
)
def test_pairs(text, want):
    assert fed(Rules(), [text]) == want


def test_joined_segments_are_the_text():
    text = "Our new supercomputer is called Gale — and it is very fast. Dr. Smith gave a talk at 3 p.m. on campus, in 2024; about 1.5 hours."
    rules = Rules(soft=24, hard=48, spaces=True)
    assert "".join(fed(rules, list(text))) == text and len(fed(rules, [text])) > 4


def test_first_clause_comes_early_once():
    assert fed(REPLY, ["はい、そうですね、いい天気です。次、です。"]) == ["はい、そうですね、", "いい天気です。", "次、です。"]
    assert fed(REPLY, ["あ、い。うえおか、き。"]) == ["あ、い。", "うえおか、き。"]
    assert fed(REPLY, ["あいうえ、", "か" * 70 + "、き"]) == ["あいうえ、", "か" * 60, "か" * 10 + "、き"]
    assert fed(REPLY, ["x。" + "あ" * 40 + "、" + "い" * 40]) == ["x。", "あ" * 40 + "、", "い" * 40]


def test_failed_streams_keep_complete_sentences_only():
    s = Segmenter()
    assert s.push("Half") == [] and s.flush(complete_only=True) == [] and s.flush() == []
    assert s.push("「Done.」") == [] and s.flush(complete_only=True) == ["「Done.」"]


def test_streams_equal_whole_texts_over_batches(spark, tmp_path):
    rng = random.Random(2)
    texts = {k: "".join(rng.choice("ab1 ,.。、」!") for _ in range(90)) for k in range(5)}
    rows = [(k, i, t[i * 10 : i * 10 + 10], i == 8, k == 4) for k, t in texts.items() for i in range(9)]
    for i in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 3 == i], "k long, i long, t string, ends boolean, bad boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k long, i long, t string, ends boolean, bad boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = segment_stream(source, "k", "i", "t", "ends", "bad", REPLY).writeStream.format("memory").queryName("replies").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination()
    got = {}
    for r in spark.table("replies").orderBy("segment_no").collect():
        got.setdefault(r.k, []).append(r.segment)
    for k, t in texts.items():
        s = Segmenter(REPLY)
        assert got.get(k, []) == s.push(t) + s.flush(complete_only=k == 4)
