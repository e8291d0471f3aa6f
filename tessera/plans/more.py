"""Further queries: readings, timers, aligned weights, rule replies, term relevance."""

from __future__ import annotations

import hashlib
import io
import zipfile

from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import binary, readings, signal
from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.operators import series as X
from tessera.functions.vocabulary import Vocabulary
from tessera.operators import terms
from tessera.plans import analytics, dialogue
from tessera.operators import chunking
from tessera.plans.common import SQL_CATALOGUE, documents
from tessera.rules import demo
from tessera.session import table
from tessera.sources import artefacts, zips
from tessera.streaming.run import scratch

FILLER_AFTER = 3600.0
TARGETS = ["click", "error", "idle", "purchase"]
#: (rank, pattern of the whole message, reply)
SCRIPTED = [(1, r"(?i)^(hi|hello|bonjour|hallo|hola)[.!?]*$", "greeting"), (2, r"(?i)^.*\b(thanks|merci|danke|gracias)\b.*$", "thanks"), (3, r"^[^a-zA-Z]*$", "unspeakable"), (4, r"^.{0,40}\?$", "short_question")]


def number_readings(spark, d):
    """Readings of order numbers, of the same with seven and with twelve zeros more, and with a zero before."""
    key = F.col("o_orderkey").cast("string")
    more = {"reading": key, "large": F.concat(key, F.lit("0000000")), "huge": F.concat(key, F.lit("000000000000")), "coded": F.concat(F.lit("0"), key)}
    return table(spark, d, "orders").select("o_orderkey", *(readings.number_reading(c).alias(n) for n, c in more.items()))


def filler_timeouts(spark, d):
    """Clicks that no other event of the user follows within an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("wait", F.lead(X.seconds("ts")).over(w) - X.seconds("ts")).filter("event_type = 'click'")
    return rows.groupBy("user_id").agg(F.count("*").alias("clicks"), F.count_if(F.col("wait").isNull() | (F.col("wait") > FILLER_AFTER)).alias("fillers"))


def blend_weights(spark, d):
    """Values by name of each user laid over the target names; missing ones are 0."""
    rows = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    named = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return named.select("user_id", *(F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0.0)).alias(t) for t in TARGETS))


def paragraph_gaps(spark, d):
    """Sentences of conversations with the pause after each: longer after the last of a turn."""
    rows = analytics.sentence_segments(spark, d)
    last = F.lead("seq").over(Window.partitionBy("conv_id", "turn").orderBy("seq")).isNull()
    return rows.groupBy("conv_id").agg(F.count("*").alias("n")).join(rows.withColumn("gap", F.when(last, 650).otherwise(300)).groupBy("conv_id").agg(F.sum("gap").alias("silence_ms")), "conv_id")


def scripted_replies(spark, d):
    text = T.single_line(F.col("text"))
    reply = F.lit(None).cast("string")
    for _, pattern, name in reversed(SCRIPTED):
        reply = F.when(text.rlike(pattern), name).otherwise(reply)
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", reply.alias("reply"))


def unknown_names(spark, d):
    """Capitalised words of user messages that no assistant message holds, counted."""
    turns = table(spark, d, "conversations")
    words = lambda role: turns.filter(F.col("role") == role).select("conv_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{4,})"), F.lit(1)))).alias("name")).distinct()
    return words("user").join(words("assistant").select("name").distinct(), "name", "left_anti").groupBy("conv_id").agg(F.count("*").alias("names"))


def effective_year(spark, d):
    """The last year from 2000 on that a text names, and the status that follows from it."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(20[0-9]{2})\b"), F.lit(1))
    year = F.try_element_at(found, F.lit(-1)).cast("int")
    status = F.when(year.isNull(), "current_or_undated").when(year >= 2024, "current").otherwise("historical")
    return documents(spark, d).select("doc_id", year.alias("year"), status.alias("status"))


def score_filter(spark, d):
    """Of each query's hits those of at least 37 % of its best score, two at most."""
    rows = dialogue._hits(spark, d)
    w = Window.partitionBy("query_id")
    kept = rows.withColumn("share", F.col("score") / F.max("score").over(w)).filter("share >= 0.37")
    return kept.withColumn("n", F.row_number().over(w.orderBy("rank"))).filter("n <= 2").select("query_id", "rank", "doc_id")


def content_relevance(spark, d):
    """Relevance of the top hits to their query's terms, word break included."""
    own = {q: [t for x, t in R.split_terms() if x == q] for q, _ in demo.QUERIES}
    column = F.array().cast("array<string>")
    for q, found in own.items():
        if found:
            column = F.when(F.col("query_id") == q, F.array(*map(F.lit, found))).otherwise(column)
    rows = dialogue._hits(spark, d)
    return rows.select("query_id", "rank", "doc_id", terms.relevance(column, F.col("title"), F.col("body"), Vocabulary({"the", "of", "this"})).alias("relevance"))


def thinking_stripped(spark, d):
    raw = F.concat(F.lit("<think>hidden\n"), F.col("role"), F.lit("</think>\n"), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.strip_thinking(raw)).alias("digest"))


def wav_files(spark, d):
    """Each turn's bytes as a WAV file and back."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("pcm"))
    return rows.select("conv_id", "turn", F.sha2(binary.wav(F.col("pcm"), 16000), 256).alias("digest"), F.md5(binary.wav_samples(binary.wav(F.col("pcm"), 16000))).alias("samples"))


def decoded_pages(spark, d):
    """Pages as bytes, decoded by sniffing the charset."""
    rows = table(spark, d, "pages").select("page_id", binary.decode_page(F.encode("html", "UTF-8"), F.lit("text/html; charset=utf-8")).alias("html"))
    return rows.select("page_id", F.md5("html").alias("digest"))


def archive_members(spark, d):
    """Pages as members of ZIP archives with their checksums, read back by many tasks and verified."""
    folder = scratch(spark, "zips")

    def pack(batches):
        for pdf in batches:
            sums = "".join(f"{hashlib.sha256((h or '').encode()).hexdigest()}  {i}.html\n" for i, h in zip(pdf["page_id"], pdf["html"]))
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("pages/checksums.sha256", sums)
                for i, h in zip(pdf["page_id"], pdf["html"]):
                    z.writestr(f"pages/{i}.html", h or "")
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(base)
            with system.open_output_stream(f"{base}/{pdf['page_id'].min()}.zip") as out:
                out.write(buffer.getvalue())
            yield pdf[["page_id"]]

    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("page_id"), "html")
    pages.mapInPandas(pack, "page_id string").count()
    spark.dataSource.register(zips.ZipSource)
    read = spark.read.format("zip").option("root", "pages").option("required", "checksums.sha256").load(folder)
    faults = zips.problems(read).select("archive", "member", "problem")
    found = zips.digests(read.filter("member <> 'checksums.sha256'"))
    return found.join(faults, ["archive", "member"], "left").select(F.regexp_replace("member", ".html$", "").cast("long").alias("page_id"), "size", "sha256", F.coalesce("problem", F.lit("none")).alias("problem"))


def turn_artefacts(spark, d):
    """A WAV file for each turn, put in place when all are written, and read back."""
    folder = scratch(spark, "artefacts")
    artefacts.register(spark)
    rows = table(spark, d, "conversations").select(F.format_string("%d/turn-%d.wav", "conv_id", "turn").alias("name"), binary.wav(F.encode("text", "UTF-8"), 16000).alias("content"))
    rows.write.format("artefacts").mode("append").save(folder)
    read = spark.read.format("artefacts").load(folder)
    place = lambda n: F.regexp_extract("name", r"([0-9]+)/turn-([0-9]+)\.wav$", n).cast("long")
    return read.select(place(1).alias("conv_id"), place(2).alias("turn"), F.length("content").cast("long").alias("bytes"), F.md5(F.expr("substring(content, 45)")).alias("samples"))


def band_limited(spark, d):
    """Vectors as signals of 48 kHz brought to 16 kHz without what that cannot hold (Arrow batches)."""
    rows = table(spark, d, "embeddings").select("vec_id", signal.band_limited(48000, 16000)(F.col("embedding").cast("array<double>")).alias("y"))
    return rows.select("vec_id", F.size("y").cast("long").alias("samples"), F.round(F.aggregate("y", F.lit(0.0), lambda a, y: a + y * y), 6).alias("energy"))


def prebuffer(spark, d):
    """For each user, the event with which five frames are buffered, and all that come after."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("have", F.row_number().over(w))
    return rows.groupBy("user_id").agg(F.min(F.when(F.col("have") == 5, F.col("event_id"))).alias("starts_at"), F.count_if(F.col("have") > 5).alias("after"))


def vocabulary_union(spark, d):
    """Lower-cased words of six sources, each once, by length: queries, intents, keywords, domains, titles of labelled documents, names of their sources."""
    split = lambda c: F.explode(F.split(F.lower(c), r"[^\p{L}]+"))
    rules = [w for ws in _RULE_WORDS for w in ws]
    listed = documents(spark, d).sparkSession.createDataFrame([(w,) for w in rules], "w string").select(split(F.col("w")).alias("w"))
    labelled = documents(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    titled = chunking.catalogue(labelled)
    words = listed.unionByName(titled.select(split(F.col("title")).alias("w"))).unionByName(titled.select(split(F.col("source")).alias("w")))
    return words.filter("w <> ''").distinct().groupBy(F.length("w").cast("long").alias("chars")).agg(F.count("*").alias("n"))


_RULE_WORDS = ([t for _, t in demo.QUERIES], [w for _, ts, _, _ in demo.INTENTS for w in ts], [k for _, k, _ in demo.KEYWORDS], [n for _, n, _ in demo.DOMAINS])
QUERIES = {f.__name__: f for f in (number_readings, filler_timeouts, blend_weights, paragraph_gaps, scripted_replies, unknown_names, effective_year, score_filter, content_relevance, thinking_stripped, wav_files, decoded_pages, archive_members, turn_artefacts, band_limited, prebuffer, vocabulary_union)}


def _pick(names, n, place):
    return f"[{', '.join(repr(x) for x in names)}][((({n}) // {10**place}) % 10 + 1)::INT]"


def _reading_sql(text):
    """The reading of a string of up to 20 digits without a leading zero."""
    parts = []
    for i in (4, 3, 2, 1, 0):
        g = f"substr(lpad({text}, 20, '0'), {4 * (4 - i) + 1}, 4)::INT"
        read = " || ".join(_pick(t, g, p) for t, p in ((readings.THOUSANDS, 3), (readings.HUNDREDS, 2), (readings.TENS, 1), (readings.ONES, 0)))
        if i > 0:
            read = f"regexp_replace({read}, '^せん', 'いっせん')"
        if i >= 3:
            read = f"regexp_replace(regexp_replace({read}, '([いは])ち$', '\\1っ'), 'じゅう$', 'じゅっ')"
        if i == 4:
            read = f"regexp_replace({read}, '([ひびぴ]ゃ)く$', '\\1っ')"
        parts.append(f"CASE WHEN {g} = 0 THEN '' ELSE ({read}) || '{readings.GROUPS[i]}' END")
    return " || ".join(parts)


def _or_zeros(n, text):
    return f"CASE WHEN o_orderkey = 0 THEN repeat('{readings.DIGITS[0]}', {n}) ELSE {_reading_sql(text)} END"


SQL = {
    "number_readings": f"""SELECT o_orderkey, {_or_zeros(1, "o_orderkey::VARCHAR")} AS reading, {_or_zeros(8, "(o_orderkey::VARCHAR || '0000000')")} AS large, {_or_zeros(13, "(o_orderkey::VARCHAR || '000000000000')")} AS huge,
        array_to_string(list_transform(string_split('0' || o_orderkey, ''), lambda x: [{", ".join(repr(x) for x in readings.DIGITS)}][x::INT + 1]), '') AS coded FROM orders""",
    "filler_timeouts": f"""WITH w AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE - epoch_us(ts) / 1e6::DOUBLE AS wait FROM events)
        SELECT user_id, count(*) AS clicks, count(*) FILTER (wait IS NULL OR wait > {FILLER_AFTER}) AS fillers FROM w WHERE event_type = 'click' GROUP BY user_id""",
    "blend_weights": "SELECT user_id, " + ", ".join(f"coalesce(max(value) FILTER (event_type = '{t}'), 0.0) AS {t}" for t in TARGETS) + " FROM events GROUP BY user_id",
    "paragraph_gaps": f"""WITH s AS (SELECT conv_id, turn, {analytics._SENT} AS parts FROM conversations)
        SELECT conv_id, sum(len(parts))::BIGINT AS n, sum(CASE WHEN len(parts) > 0 THEN 650 + 300 * (len(parts) - 1) ELSE 0 END)::BIGINT AS silence_ms FROM s GROUP BY conv_id HAVING sum(len(parts)) > 0""",
    "scripted_replies": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches({dialogue._LINE}, '{p}') THEN '{n}'" for _, p, n in SCRIPTED) + " END AS reply FROM conversations WHERE role = 'user'",
    "unknown_names": """WITH w AS (SELECT DISTINCT conv_id, role, unnest(regexp_extract_all(text, '([A-Z][a-z]{4,})', 1)) AS name FROM conversations)
        SELECT conv_id, count(*) AS names FROM w WHERE role = 'user' AND name NOT IN (SELECT name FROM w WHERE role = 'assistant') GROUP BY conv_id""",
    "effective_year": r"""WITH y AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\b(20[0-9]{2})\b', 1)[-1]::INT AS year FROM documents)
        SELECT doc_id, year, CASE WHEN year IS NULL THEN 'current_or_undated' WHEN year >= 2024 THEN 'current' ELSE 'historical' END AS status FROM y""",
    "score_filter": f"""{dialogue._HITS}, s AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS share FROM hits_),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM s WHERE share >= 0.37::DOUBLE) SELECT query_id, rank, doc_id FROM n WHERE n <= 2""",
    "thinking_stripped": "SELECT conv_id, turn, md5(text) AS digest FROM conversations",
    "decoded_pages": "SELECT page_id, md5(html) AS digest FROM pages",
    "prebuffer": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS have FROM events)
        SELECT user_id, min(event_id) FILTER (have = 5) AS starts_at, count(*) FILTER (have > 5) AS after FROM r GROUP BY user_id""",
    "turn_artefacts": "SELECT conv_id, turn, (octet_length(encode(text)) + 44)::BIGINT AS bytes, md5(text) AS samples FROM conversations",
    "archive_members": "SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS size, sha256(coalesce(html, '')) AS sha256, 'none' AS problem FROM pages",
    "vocabulary_union": f"""WITH {SQL_CATALOGUE}, t AS (SELECT * FROM cat WHERE doc_id IN (SELECT doc_id FROM labels)),
        r AS (SELECT unnest([{", ".join("'" + w.replace("'", "''") + "'" for ws in _RULE_WORDS for w in ws)}]) AS w UNION ALL SELECT title FROM t UNION ALL SELECT source FROM t),
        w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(w), '[^\\p{{L}}]+')) AS w FROM r) SELECT length(w) AS chars, count(*) AS n FROM w WHERE w <> '' GROUP BY 1""",
}
