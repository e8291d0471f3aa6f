"""Stream operators over the given tables, each with its batch twin as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.analytics import VOICED
from tessera.session import table
from tessera.sources import frames, sse
from tessera.streaming.run import drained, stream_of
from tessera.streaming.stateful import sentence_stream, utterance_stream


def _with_last(spark, d, name, key, seq):
    """The table as a stream whose rows know whether they are the last of their key."""
    last = table(spark, d, name).groupBy(key).agg(F.max(seq).alias("last_seq"))
    return stream_of(spark, d, name).join(last, key).withColumn("ends", F.col(seq) == F.col("last_seq"))


def stream_sentences(spark, d):
    return drained(sentence_stream(_with_last(spark, d, "conversations", "conv_id", "turn"), "conv_id", "turn", "text", "ends"), "sentences")


def stream_vad(spark, d):
    frames_ = _with_last(spark, d, "events", "user_id", "event_id").withColumn("voiced", F.abs("value") >= VOICED)
    return drained(utterance_stream(frames_, "user_id", "event_id", "voiced", "ends"), "vad").select("user_id", "first", "last", "voiced_frames")


def stream_endpoints(spark, d):
    """The same with a start of two voiced frames, four of lead-in, three voiced ones at least and a cap of 40 frames."""
    frames_ = _with_last(spark, d, "events", "user_id", "event_id").withColumn("voiced", F.abs("value") >= VOICED)
    return drained(utterance_stream(frames_, "user_id", "event_id", "voiced", "ends", 2, 3, 3, 40, 4), "endpoints")


def stream_windows(spark, d):
    """Daily counts of each event type, a day being closed an hour after its end."""
    ev = stream_of(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    agg = ev.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return drained(agg.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "peak"), "windows")


def stream_turn_log(spark, d):
    """Turns as JSON files partitioned by day, counted as they are read back."""
    rows = stream_of(spark, d, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return drained(rows, "turn-log", ("day",), "json").groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def frame_codec(spark, d):
    """Events as binary audio frames, packed and unpacked."""
    rows = table(spark, d, "events").select("event_id", frames.pack(F.lit(1), F.lit(16000), F.col("user_id"), F.encode("event_type", "UTF-8")).alias("frame"))
    return rows.select("event_id", F.hex("frame").alias("frame"), frames.unpack(F.col("frame")).alias("f")).select("event_id", "frame", F.col("f.rate").alias("rate"), F.col("f.size").alias("size"), F.decode("f.payload", "UTF-8").alias("payload"))


def sse_deltas(spark, d):
    """Assistant messages as server-sent event lines with a stray delta after the end mark, parsed back to deltas."""
    turns = table(spark, d, "conversations").filter("role = 'assistant'")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    late = F.lit('data: {"choices": [{"delta": {"content": "late"}}]}')
    lines = turns.select("conv_id", "turn", F.posexplode(F.array(F.concat(F.lit("data: "), body), F.lit(""), F.lit("data: [DONE]"), late)).alias("pos", "line"))
    return sse.deltas(lines, ["conv_id", "turn"], "pos").select("conv_id", "turn", F.md5("delta").alias("digest"))


def control_messages(spark, d):
    """Events as control messages: serialised, parsed, faulty ones told apart."""
    rows = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias("type"), F.col("user_id").cast("string").alias("session_id"))).alias("raw"))
    got = rows.select("event_id", F.from_json("raw", "type string, session_id string, payload map<string,string>").alias("m"))
    return got.select("event_id", F.coalesce("m.type", F.lit("invalid")).alias("type"), "m.session_id", F.size(F.coalesce("m.payload", F.create_map().cast("map<string,string>"))).cast("long").alias("payload_size"))


def session_states(spark, d):
    """Half-duplex drop: views between a click and the next purchase of a user are not taken."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    state = F.last(F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")), ignorenulls=True).over(w)
    rows = table(spark, d, "events").withColumn("state", F.when(state == "click", "speaking").otherwise("listening"))
    return rows.filter("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("views"), F.count_if(F.col("state") == "listening").alias("taken"))


QUERIES = {f.__name__: f for f in (stream_sentences, stream_vad, stream_endpoints, stream_windows, stream_turn_log, frame_codec, sse_deltas, control_messages, session_states)}
SQL = {
    "stream_sentences": r"""WITH t AS (SELECT conv_id, regexp_extract_all(string_agg(text, '' ORDER BY turn), '[^.!?\n]+[.!?\n]*') AS ps FROM conversations GROUP BY conv_id),
        u AS (SELECT conv_id, unnest(range(0, len(ps))) AS i, ps FROM t), s AS (SELECT conv_id, i, regexp_replace(ps[i + 1], '^\s+|\s+$', '', 'g') AS segment FROM u)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS segment_no, segment FROM s WHERE segment <> ''""",
    "stream_vad": f"""WITH r AS (SELECT user_id, event_id, abs(value) >= {VOICED} AS is_on, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
        v AS (SELECT *, CASE WHEN rn - lag(rn) OVER w > 3 THEN 1 ELSE 0 END AS cut FROM r WHERE is_on WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
        g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY rn) AS grp FROM v)
        SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS voiced_frames FROM g GROUP BY user_id, grp""",
    "stream_windows": """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events) SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, max(value) AS peak FROM events, m
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= wm GROUP BY ALL""",
    "stream_turn_log": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "frame_codec": """SELECT event_id, '41434531' || '01010101' || lpad(hex(16000), 8, '0') || lpad(hex(strlen(event_type)), 8, '0') || lpad(hex(user_id), 32, '0') || hex(encode(event_type)) AS frame,
        16000 AS rate, strlen(event_type) AS size, event_type AS payload FROM events""",
    "sse_deltas": "SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE role = 'assistant'",
    "control_messages": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'invalid' ELSE event_type END AS type, user_id::VARCHAR AS session_id, 0::BIGINT AS payload_size FROM events",
    "session_states": """WITH s AS (SELECT *, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM events)
        SELECT user_id, count(*) AS views, count(*) FILTER (st IS NULL OR st <> 'click') AS taken FROM s WHERE event_type = 'view' GROUP BY user_id""",
}
