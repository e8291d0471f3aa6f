"""Edge cases of single operators, on small rows."""

from __future__ import annotations

import io
import random
import struct
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import binary, readings, signal, speech, text, web
from tessera.operators import chunking, crawl, dialogue, evaluation, retrieval, series
from tessera.sources import archives, files, frames, sse


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long' if isinstance(v, int) else 'array<double>'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("a\r\nb", "a\nb"), ("a \t b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("　 a 　", "a"), ("", "")],
)
def test_normalize(spark, given, want):
    assert one(spark, text.normalize(F.col("t")), t=given) == want


def test_windows_cover_and_keep_the_contained_last_one(spark):
    got = one(spark, text.windows(F.col("t")), t="x" * 1600)
    assert [(w.start, len(w.text)) for w in got] == [(0, 900), (780, 820), (1560, 40)]
    assert one(spark, text.windows(F.col("t")), t="") == []


def test_short_ascii_terms_match_whole_words(spark):
    assert one(spark, text.has_term(F.col("t"), F.lit("ai")), t="an AI here") is True
    assert one(spark, text.has_term(F.col("t"), F.lit("ai")), t="maintain") is False
    assert one(spark, text.has_term(F.col("t"), F.lit("大学")), t="東京大学院") is True


def test_sections_and_title(spark):
    doc = "# Top\nintro\n## One\nbody 1\n## Empty\n## Two\nbody 2"
    assert [(s.heading, s.body) for s in one(spark, text.sections(F.col("t")), t=doc)] == [("One", "body 1"), ("Two", "body 2")]
    assert one(spark, text.title_or(F.col("t"), F.lit("f")), t=doc) == "Top" and one(spark, text.title_or(F.col("t"), F.lit("f")), t="no") == "f"


def test_paragraph_packing_is_greedy(spark):
    df = spark.createDataFrame([(1, "aaaa\nbbbb\ncccccccccccc\nd"), (2, "")], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_index): r.text for r in chunking.pack_paragraphs(df, 10).collect()}
    assert got == {(1, 0): "aaaa\nbbbb", (1, 1): "cccccccccc", (1, 2): "cc\nd"}


def test_fingerprint_changes_only_with_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    digest = lambda df: chunking.fingerprint(df).first()["digest"]
    assert digest(a) == digest(a.orderBy(F.desc("doc_id"))) != digest(a.filter("doc_id = 1"))


def test_diversified_equals_a_fold(spark):
    rng = random.Random(3)
    rows = [(q, 100.0 - rank, rng.choice("abcd"), f"p{rank:03}", 0) for q in range(20) for rank in range(1, 15)]
    got = retrieval.diversified(spark.createDataFrame(rows, "query_id int, score double, grp string, path string, chunk_index int"), ["grp"], 5)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.place, r.path))
    for q in range(20):
        seen, first, later = set(), [], []
        for _, _, g, path, _ in (r for r in rows if r[0] == q):
            (later if g in seen else first).append(path)
            seen.add(g)
        assert [path for _, path in sorted(by[q])] == (first + later)[:5]
    with pytest.raises(ValueError):
        retrieval.diversified(got, ["grp"], 0)


def test_short_terms_are_capped_for_each_query():
    found = retrieval.short_terms([(1, "aa bb cc dd ee ff gg hh ii jj"), (2, "kk")], 8)
    assert [q for q, _ in found].count(1) == 8 and (2, "kk") in found


def test_dedupe_keeps_first_on_ties(spark):
    rows = [(1, "k", 2.0, 1), (1, "k", 2.0, 0), (1, "k", 1.0, 2)]
    df = spark.createDataFrame(rows, "query_id int, id string, score double, src int")
    assert [r.src for r in retrieval.best_of_each(df, ["query_id", "id"], "score", "src").collect()] == [0]


def test_domain_fallback(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "query_id int, d string")
    got = retrieval.keep_domain_or_all(df, F.col("d") == "a").select("query_id", "d").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b")]


def test_budget_equals_a_fold(spark):
    rng = random.Random(1)
    rows = [(q, r, "h" * rng.randint(1, 9), "b" * rng.randint(0, 60)) for q in range(15) for r in range(1, 9)]
    got = dialogue.budgeted(spark.createDataFrame(rows, "query_id int, rank int, header string, body string"), 120)
    mine = {(r.query_id, r.rank): r.packed for r in got.collect()}
    want = {}
    for q in range(15):
        used = 0
        for _, r, h, b in (x for x in rows if x[0] == q):
            left = 120 - used - len(h) - 8
            if not b:
                continue
            if left <= 0:
                break
            packed = b if len(b) <= left else b[: left - 1].rstrip() + "..."
            want[q, r] = packed
            used += len(h) + len(packed) + 2
    assert mine == want


def test_followup_takes_the_latest_routed_message(spark):
    rows = [(1, 0, "user", "the license terms"), (1, 1, "assistant", "x"), (1, 2, "user", "zzz"), (1, 3, "user", "more on that"), (2, 0, "user", "more on that")]
    got = dialogue.resolve_followups(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(r.conv_id, r.turn): r.resolved for r in got.collect()} == {(1, 0): "the license terms", (1, 2): "zzz", (1, 3): "the license terms more on that", (2, 0): "more on that"}


def test_temporal_boost_order(spark):
    from tessera.rules import demo

    cases = [(2021, "current_2021", [2021], 180), (2021, "current_2021", [], 35), (2020, "historical_result", [], -70), (2020, "historical_old", [2020], 170), (2020, "versioned_page_verify_year", [2021], -270), (None, "", [2020], -20)]
    wants = [(2026, "historical_result", [], 12, False, True), (2026, "planned_subject_to_change", [], 130, True, False), (2026, "recruitment_closed_early", [2026], -10, False, False)]
    for year, status, asked, want, plan, result in [(*c, False, False) for c in cases] + wants:
        row = spark.createDataFrame([(year, status, asked, plan, result)], "effective_year int, temporal_status string, asked array<int>, wants_plan boolean, wants_result boolean")
        base = F.expr("case " + " ".join(f"when {c} then {n}" for c, n in demo.YEAR_POINTS) + " end")
        assert row.select(dialogue.rule_points(demo.STATUS_POINTS, F.col("temporal_status"), base).alias("x")).first()["x"] == want


def test_dates_skip_invalid_ones(spark):
    got = one(spark, dialogue.dates_in(F.col("t")), t="2026-02-31 and 2026-03-01 or 2025-1-1")
    assert [str(x) for x in got] == ["2026-03-01"]


def test_frame_spans_add_up(spark):
    spans = spark.range(30).select(series.frame_span(F.col("id"), 16000, 30).alias("s")).select("s.*").collect()
    assert {r.end - r.start for r in spans} == {533, 534} and sum(r.end - r.start for r in spans) == 16000


def test_session_ends_at_equality(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 5, 15, 24])]
    df = spark.createDataFrame(rows, "u long, i long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.session for r in series.sessions(df, "u", "ts", "i", 10.0).orderBy("i").collect()] == [0, 0, 1, 1]


def test_interval_join_against_brute_force(spark):
    rng = random.Random(2)
    samples, spans = [(i, rng.random() * 50, rng.random()) for i in range(200)], [(i, s, s + rng.random() * 9) for i in range(40) for s in [rng.random() * 60]]
    got = series.interval_join(spark.createDataFrame(samples, "k long, t double, v double"), spark.createDataFrame(spans, "id long, a double, b double"), "t", "a", "b", 3.0)
    assert sorted((r.id, r.k) for r in got.collect() if r.k is not None) == sorted((i, k) for i, a, b in spans for k, t, _ in samples if a <= t <= b)
    assert {r.id for r in got.collect()} == set(range(40))


def test_reach_is_breadth_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a")], "src string, dst string")
    got = crawl.reach(edges, spark.createDataFrame([("a",)], "node string"), 2)
    assert {(r.node, r.depth) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_zero_counts(spark):
    got = evaluation.counts_with_zeros(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a",), ("b",)], "k string"), "k")
    assert {(r.k, r.n) for r in got.collect()} == {("a", 1), ("b", 0)}


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTP://A.org:80//x//y?utm_a=1&b=2&a=1&gclid=3#f", "http://a.org/x/y?a=1&b=2"), ("https://a.org", "https://a.org/"), ("ftp://a.org/", None), ("https://a.org:443/?ref=x", "https://a.org/")],
)
def test_canonical_url(spark, url, want):
    assert one(spark, web.canonical_url(F.col("t")), t=url) == want


def test_speech(spark):
    assert one(spark, speech.normalize_speech(F.col("t")), t="## Ａ１ **b** [c](http://x) 5% & https://y.z") == "A1 b c 5 percent and link"
    assert one(spark, speech.sentences(F.col("t")), t="One. Two!! ... \nThree") == ["One.", "Two!!", "Three"]
    assert one(spark, speech.coalesce_tail(speech.sentences(F.col("t")), 2), t="A. B. C.") == ["A.", "B. C."]
    assert one(spark, speech.mora_tenths(F.col("t")), t="かきゃ漢1ab") == 2 * 10 + 17 + 15 + 2 * 10
    assert one(spark, speech.mora_tenths(F.col("t")), t="Ａ、WH〇ー。") == 20 + 20 + 40 + 30 + 20 + 10


def test_pcm_codec(spark):
    got = one(spark, signal.to_pcm16(F.col("t")), t=[0.0, 1.0, -1.0, 2.0, 0.5])
    assert got == [0, 32767, -32768, 32767, 16384]
    assert one(spark, F.size(signal.resample(16000, 8000)(F.col("t"))), t=[0.0] * 100) == 50
    assert one(spark, signal.trim_quiet(2)(F.col("t")), t=[0.0] * 10 + [1.0, 1.0] + [0.0] * 4) == [1.0, 1.0]


def test_frames(spark):
    frame = spark.range(1).select(frames.pack(F.lit(1), F.lit(16000), F.lit(7), F.lit(b"abc")).alias("f")).first()["f"]
    assert bytes(frame) == struct.pack("!4sBBBBII16s", b"ACE1", 1, 1, 1, 1, 16000, 3, (7).to_bytes(16, "big")) + b"abc"
    bad = spark.createDataFrame([(bytes(frame)[:-1],), (b"short",), (b"X" + bytes(frame)[1:],)], "f binary")
    assert [r.x for r in bad.select(frames.unpack(F.col("f")).alias("x")).collect()] == [None, None, None]


def test_sse(spark):
    lines = ['data: {"choices":[{"delta":{"content":"a"}}]}', "", 'data: {"choices":[{"message":{"content":"b"}}]}', 'data: {"content":"c"}', "data: {broken", ": note", "data: [DONE]", 'data: {"content":"late"}']
    got = sse.deltas(spark.createDataFrame([(s, i, x) for s in (1, 2) for i, x in enumerate(lines)], "s int, i long, line string"), ["s"], "i")
    assert sorted((r.s, r.i, r.delta) for r in got.collect()) == [(s, i, d) for s in (1, 2) for i, d in ((0, "a"), (2, "b"), (3, "c"))]


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    df = spark.createDataFrame([("a.zip", _zip({"d/x.txt": "hi", "y.txt": ""}))], "path string, content binary")
    got = archives.members(df)
    assert {(r.member, r.size) for r in got.collect()} == {("d/x.txt", 2), ("y.txt", 0)}
    expected = spark.createDataFrame([("y.txt", "0"), ("z.txt", "0")], "member string, sha256 string")
    assert {tuple(r) for r in archives.mismatches(got, expected).collect()} == {("y.txt", "differs"), ("z.txt", "missing")}
    with pytest.raises(Exception, match="leaves the archive"):
        archives.members(spark.createDataFrame([("a.zip", _zip({"../x": "hi"}))], "path string, content binary")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "a.md").write_bytes(b"ok \xff")
    (tmp_path / "t" / "sub" / "b.txt").write_text("deep")
    (tmp_path / "t" / "c.bin").write_text("no")
    assert sorted(r.text for r in files.text_files(spark, str(tmp_path / "t")).collect()) == ["deep", "ok �"]
    (tmp_path / "r.jsonl").write_text('{"id":"1","n":2}\nnot json\n\n{"n":3}\n')
    rows = files.json_lines(spark, str(tmp_path / "r.jsonl"), "id string, n int", ("id",))
    assert sorted(map(str, (r["_problem"] for r in rows.collect()))) == ["None", "id", "malformed"]
    (tmp_path / ".env").write_text("# c\nexport A=1\nB = 'two words'\n\nnonsense\n")
    (tmp_path / "env.txt").write_text((tmp_path / ".env").read_text())
    assert {tuple(r) for r in files.env_lines(spark, str(tmp_path / "env.txt")).collect()} == {("A", "1"), ("B", "two words")}


def test_versioned_table_keeps_the_old_version_on_failure(spark, tmp_path):
    t = files.VersionedTable(spark, str(tmp_path / "v"))
    t.publish(spark.range(3))
    with pytest.raises(ValueError, match="does not verify"):
        t.publish(spark.range(0))
    assert t.current().count() == 3
    t.publish(spark.range(5))
    assert t.current().count() == 5


@pytest.mark.parametrize(
    ("n", "want"),
    [(0, "ぜろ"), (10, "じゅう"), (300, "さんびゃく"), (3600, "さんぜんろっぴゃく"), (8001, "はっせんいち"), (10_000, "いちまん"), (10**12, "いっちょう"), (10**16 + 1, "いっけいいち"), (2024, "にせんにじゅうよん"), (10**7, "いっせんまん"), (10**13, "じゅっちょう"), (8 * 10**12, "はっちょう"), (10**18, "ひゃっけい"), (6 * 10**18, "ろっぴゃっけい")],
)
def test_readings(spark, n, want):
    assert one(spark, readings.integer_reading(F.col("n")), n=n) == want


def test_number_strings(spark):
    for text, want in (("007", "ぜろぜろなな"), ("1,000", "せん"), ("99999999999999999999", "きゅうせんきゅうひゃくきゅうじゅうきゅうけい" + "きゅうせんきゅうひゃくきゅうじゅうきゅうちょう" + "きゅうせんきゅうひゃくきゅうじゅうきゅうおく" + "きゅうせんきゅうひゃくきゅうじゅうきゅうまん" + "きゅうせんきゅうひゃくきゅうじゅうきゅう"), ("1" + "0" * 20, "いち" + "ぜろ" * 20), ("x1", "x1")):
        assert one(spark, readings.number_reading(F.col("t")), t=text) == want


def test_wav(spark):
    data = bytes(spark.range(1).select(binary.wav(F.lit(b"\x01\x02\x03\x04"), 16000).alias("w")).first()["w"])
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(9)) == (16000, 1, 2, b"\x01\x02\x03\x04")
    df = spark.createDataFrame([(data,), (b"no",)], "d binary").select(binary.wav_samples(F.col("d")).alias("s"))
    assert [r.s and bytes(r.s) for r in df.collect()] == [b"\x01\x02\x03\x04", None]


def test_page_charsets(spark):
    rows = [("é".encode("latin-1"), "text/html; charset=latin-1", "é"), ("é".encode(), None, "é"), ("日本".encode("cp932"), "text/html", "日本"), (None, None, None), ("日".encode(), "x; charset=nonsense", "日")]
    df = spark.createDataFrame([(d, h) for d, h, _ in rows], "d binary, h string")
    assert [r.t for r in df.select(binary.decode_page("d", "h").alias("t")).collect()] == [w for _, _, w in rows]
