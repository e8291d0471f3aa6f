"""Further steps of import, query understanding, evidence and speech, each a query with its SQL."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import pages as P
from tessera.functions import query_text as Q
from tessera.functions import readings
from tessera.functions import segments as S
from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.functions.spoken import Rewriter
from tessera.operators import chunking
from tessera.plans import retrieval as PR
from tessera.plans.common import SQL_CATALOGUE, documents
from tessera.plans.dialogue import _HITS, _hits
from tessera.rules import demo, spoken
from tessera.session import table
from tessera.streaming.run import drained, scratch
from tessera.streaming.stateful import frame_stream, segment_stream
from tessera.plans.streams import _with_last

META = ("source_url", "record_type", "accessed_date", "publisher")
PUBLISHERS = (("example.com", "Example Press"), ("example.org", "Example Archive"))
ASR_RULES = [("(?i)licen[cs]e", "license"), ("(?i)e-?mail", "email"), (r"\bthe\s+the\b", "the")]
STOP = ("the", "and", "of", "to", "in", "is", "for", "what", "how", "tell", "me", "about")
PLACES = ("berlin", "paris", "madrid", "london", "this", "that")
#: (rank, name, condition over a document, points): of each name the first rule that fits counts
BOOSTS = [(1, "type", "record_type = 'guide'", 60), (2, "type", "record_type = 'notice'", 25), (3, "type", "record_type <> ''", -10), (1, "source", "source_priority = 'P0'", 40), (2, "source", "source_priority = 'P1'", 15), (1, "status", "temporal_status like 'current%'", 30), (2, "status", "temporal_status like 'historical%'", -45)]
OUTAGE = ("error",)
READ_ALOUD = Rewriter.of(spoken.STAGES)
LIMIT = 3


def _users(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'")


def normalized_queries(spark, d):
    """User messages in compatibility form, numerals of years in digits (Arrow batches)."""
    return _users(spark, d).select("conv_id", "turn", F.md5(Q.normalized_query("text")).alias("digest"))


def asr_replacements(spark, d):
    return _users(spark, d).select("conv_id", "turn", F.md5(T.replace_rules(F.col("text"), ASR_RULES)).alias("digest"))


def content_terms(spark, d):
    """Words of a question without stop words, places and figures, each once."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+")
    kept = F.filter(F.array_distinct(words), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP, *PLACES) & ~w.rlike("^[0-9]+$"))
    return _users(spark, d).select("conv_id", "turn", F.array_join(kept, " ").alias("terms"))


def segmented_terms(spark, d):
    """Words of six letters or more of each question that no sequence of short benchmark words spells."""
    short = F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w).between(2, 4))).alias("w")
    words = V.collected(table(spark, d, "benchmark").select(short))
    rows = _users(spark, d)
    rules = V.TermRules(run="(?<![^ .,;:!?])[a-z]{6,}(?![^ .,;:!?])")
    return rows.select("conv_id", "turn", F.array_join(V.content_terms_of(F.translate(F.lower("text"), "\n\t", "  "), rows, words, rules), " ").alias("terms"))


def query_locations(spark, d):
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(low.contains(p), F.lit(p)) for p in PLACES)))
    return _users(spark, d).select("conv_id", "turn", F.array_join(found, ",").alias("places"))


def previous_messages(spark, d):
    """A message after a short one is read together with it (the lag join of a fragment)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _users(spark, d).withColumn("before", F.lag("text").over(w))
    joined = F.when(F.length("before") <= 40, F.concat("before", F.lit(" "), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", (F.length("before") <= 40).alias("joined"), F.md5(joined).alias("digest"))


def person_gate(spark, d):
    """Does a message name somebody and ask nothing that the rules know?"""
    named = F.col("text").rlike("[A-Z][a-z]{3,} [A-Z][a-z]{3,}")
    known = T.contains_any(F.lower("text"), [t for _, ts, _, _ in demo.INTENTS for t in ts])
    return _users(spark, d).select("conv_id", "turn", F.coalesce(named & ~known, F.lit(False)).alias("needs_check"))


def provider_limits(spark, d):
    """How many candidates and results to ask for: more where tables or figures are asked about."""
    wide = F.lower("text").rlike("table|figure|chart|diagram")
    rerank = F.when(wide, F.greatest(F.lit(5), F.lit(10))).otherwise(F.lit(5))
    return _users(spark, d).select("conv_id", "turn", rerank.alias("rerank"), F.greatest(F.lit(8), rerank).alias("candidates"))


def transcript_gate(spark, d):
    bare = F.regexp_replace(F.lower("text"), "[^a-z0-9]+", "")
    reason = F.when(F.trim("text") == "", "empty").when(bare.isin("thanksforwatching", "hello", "thankyou"), "filler").when(F.length(F.trim("text")) > 1000, "too_long").otherwise("accepted")
    return _users(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def speakable(spark, d):
    ok = F.col("text").rlike(r"[0-9A-Za-z\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{30FC}\x{4E00}-\x{9FFF}]")
    return table(spark, d, "conversations").groupBy("role").agg(F.count_if(ok).alias("speakable"), F.count("*").alias("n"))


def _noted(spark, d):
    """Documents with metadata lines before their text, some of them blank or unknown."""
    head = F.concat(
        F.lit("\nsource_url: https://"), F.when(F.col("doc_id") % 3 == 0, "www.example.com/").when(F.col("doc_id") % 3 == 1, "example.org/").otherwise("other.net/"), "source", F.lit("\nrecord_type: "), "lang", F.lit("\n\n"),
        F.when(F.col("doc_id") % 2 == 0, "accessed_date: 2026-01-02\n").otherwise("unknown_key: x\n"), F.lit("publisher:\n"),
    )
    return documents(spark, d).select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def front_matter(spark, d):
    """Metadata lines, with defaults: the date of the import, the publisher of the host."""
    rows = _noted(spark, d).withColumn("f", P.front_matter(F.col("text"), META))
    value = lambda k: F.coalesce(F.try_element_at(F.transform(F.filter("f.meta", lambda m: m["key"] == k), lambda m: m["value"]), F.lit(-1)), F.lit(""))
    rows = rows.select("doc_id", "f.body", *(value(k).alias(k) for k in META))
    host = F.regexp_extract("source_url", "^https?://([^/]+)", 1)
    named = reduce(lambda c, p: F.when((host == p[0]) | host.endswith("." + p[0]), p[1]).otherwise(c), PUBLISHERS, F.lit(""))
    filled = lambda c, other: F.when(F.col(c) == "", other).otherwise(F.col(c)).alias(c)
    return rows.select("doc_id", "source_url", "record_type", filled("accessed_date", F.lit("2026-06-30")), filled("publisher", named), F.md5("body").alias("body"))


def prompt_bodies(spark, d):
    """Bodies for a prompt: no headings, links to their text, no lines of addresses, blank lines folded."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~x.rlike(r"^\s*#|@|https?://"))
    c = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\[([^\]]*)\]\([^)]*\)", "$1"), "\n{2,}", "\n")
    return documents(spark, d).select("doc_id", F.length(c).cast("long").alias("chars"), F.md5(c).alias("digest"))


def validated_hosts(spark, d):
    """https and a listed host, else the reason."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1))
    listed = host.rlike(r"(^|\.)example\.(com|org)$")
    problem = F.when(~F.col("url").startswith("https://"), "not_https").when(~listed, "host")
    return table(spark, d, "pages").select("page_id", F.coalesce(problem, F.lit("ok")).alias("problem"))


def page_lines(spark, d):
    """Main text of pages as lines, those pages only that have 120 characters of it."""
    text = F.array_join(P.main_lines(F.col("html")), "\n")
    rows = table(spark, d, "pages").select("page_id", text.alias("text"))
    return rows.filter(F.length("text") >= 120).select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def link_labels(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(P.labelled_links(F.col("html"))).alias("pos", "l"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "l.href", "l.label")


def page_headings(spark, d):
    first = F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, d, "pages").select("page_id", P.safe_heading(F.concat(F.lit("## "), first)).alias("heading"))


def bounded_hosts(spark, d):
    """Of each host the first pages by id, and whether it has more."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    w = Window.partitionBy("host").orderBy("page_id")
    rows = table(spark, d, "pages").select("page_id", host.alias("host")).withColumn("n", F.row_number().over(w))
    return rows.filter(F.col("n") <= LIMIT + 1).groupBy("host").agg(F.count_if(F.col("n") <= LIMIT).alias("kept"), (F.max("n") > LIMIT).alias("more"))


def category_pages(spark, d):
    """Pages of each category, one list after the other, with the place in its own."""
    base = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "://[^/?#]*/([a-z]{2})/", 1)).alias("category"))
    parts = [base.filter(F.col("category") == c).withColumn("list", F.lit(n)) for n, c in enumerate(("en", "de", "fr"))]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("list").orderBy("page_id"))).select("page_id", "category", "list", "place")


def manifest_sources(spark, d):
    """A JSON document of sources, written and read back, exploded and counted against documents."""
    docs = documents(spark, d)
    entries = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    one = entries.groupBy(F.lit(1).alias("version")).agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("source_id"), F.concat(F.lit("https://"), "source", F.lit(".example.org")).alias("url"), "first"))).alias("sources"))
    path = scratch(spark, "manifest")
    one.coalesce(1).write.json(path)
    read = spark.read.schema("version int, sources array<struct<source_id: string, url: string, first: long>>").json(path)
    listed = read.select(F.explode("sources").alias("s")).select("s.*")
    return docs.join(F.broadcast(listed), docs["source"] == listed["source_id"]).groupBy("source_id", "url", "first").agg(F.count("*").alias("documents"))


def source_url_mismatches(spark, d):
    """Ids and URLs of each document, paired by position and compared with the manifest."""
    docs = documents(spark, d).select("doc_id", F.array(F.col("source"), F.lit("src1")).alias("ids"), F.array(F.concat(F.lit("https://"), "source"), F.when(F.col("doc_id") % 5 == 0, "https://wrong").otherwise("https://src1")).alias("urls"))
    pairs = docs.select("doc_id", F.explode(F.arrays_zip("ids", "urls")).alias("p")).select("doc_id", F.col("p.ids").alias("source_id"), F.col("p.urls").alias("url"))
    manifest = documents(spark, d).select(F.col("source").alias("source_id")).distinct().withColumn("known", F.concat(F.lit("https://"), "source_id"))
    bad = pairs.join(manifest, "source_id", "left").filter(F.col("known").isNull() | (F.col("known") != F.col("url")))
    return bad.groupBy("source_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def json_rows(spark, d):
    """JSON lines of documents, some damaged, blank or without a field, each with its problem; the file is read as it would come."""
    body = F.to_json(F.struct("doc_id", "lang", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source")))
    line = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("{oops "), F.col("doc_id").cast("string"))).otherwise(body)
    path = scratch(spark, "json-lines")
    documents(spark, d).select(line.alias("value")).write.text(path)
    rows = spark.read.text(path).filter(F.trim("value") != "").withColumn("r", F.from_json("value", "doc_id long, lang string, source string"))
    problem = F.when(~F.col("value").startswith('{"'), "malformed").when(F.col("r.source").isNull(), "source").otherwise("ok")
    return rows.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"), F.sum("r.doc_id").alias("ids"))


def without_known_bad(spark, d):
    """All documents but one known to be wrong, which must be there exactly once."""
    docs = documents(spark, d)
    bad = F.col("doc_id") == F.lit(1)
    checked = docs.groupBy("lang").agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("bad"))
    total = F.sum("bad").over(Window.partitionBy())
    return checked.withColumn("exactly_one", total == 1).select("lang", "kept", "exactly_one")


def required_evidence(spark, d):
    """Is there a document of each wanted kind?"""
    docs = chunking.catalogue(documents(spark, d))
    kinds = {"guide_p0": "record_type = 'guide' and source_priority = 'P0'", "future": "effective_year >= 2030", "french": "lang = 'fr'"}
    counted = docs.agg(*(F.bool_or(F.expr(p)).alias(k) for k, p in kinds.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit(False)).alias("found")) for k in kinds))).alias("x")).select("x.*")


def strict_domain(spark, d):
    """A stricter test of one domain: the type must fit and a metadata field must name the source."""
    docs = chunking.catalogue(documents(spark, d))
    fits = F.when(F.col("record_type") == "guide", F.concat_ws(" ", "title", "path").contains("src1")).otherwise(F.col("record_type").isin("profile"))
    return docs.groupBy("lang").agg(F.count_if(fits).alias("hits"), F.count("*").alias("n"))


def rule_boosts(spark, d):
    """Points of each document: of each rule name the first rule that fits, all names added up; rules are joined as rows."""
    docs = chunking.catalogue(documents(spark, d)).select("doc_id", "record_type", "source_priority", "temporal_status")
    rules = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(n).alias("name"), F.expr(c).alias("fits"), F.lit(p).alias("points")) for r, n, c, p in BOOSTS))
    met = docs.select("doc_id", F.explode(F.filter(rules, lambda r: F.coalesce(r["fits"], F.lit(False)))).alias("r"))
    first = met.groupBy("doc_id", "r.name").agg(F.min_by("r.points", "r.rank").alias("points"))
    return first.groupBy("doc_id").agg(F.sum("points").cast("long").alias("boost"), F.count("*").alias("rules"))


def evidence_text(spark, d):
    """The bodies of each query's hits in rank order, as one text."""
    rows = _hits(spark, d).filter("rank <= 5")
    joined = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"]), " ").alias("t"))
    return joined.select("query_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


def expected_hits(spark, d):
    """Queries of whose expected documents one is among the hits."""
    hits = _hits(spark, d).select("query_id", "doc_id", "rank")
    expected = spark.createDataFrame([(q, i) for q, _ in demo.QUERIES for i in range(0, 200, 7)], "query_id int, doc_id long")
    met = hits.join(F.broadcast(expected), ["query_id", "doc_id"], "left_semi")
    return hits.groupBy("query_id").agg(F.count("*").alias("hits")).join(met.groupBy("query_id").agg(F.count("*").alias("expected_hits"), F.min("rank").alias("best")), "query_id", "left").select("query_id", "hits", F.coalesce("expected_hits", F.lit(0)).alias("expected_hits"), "best")


def zipped_citations(spark, d):
    """Hits and citation payloads, paired by position."""
    lists = _hits(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("hits"), F.sort_array(F.collect_list(F.struct("rank", "title"))).alias("cites"))
    left = lists.select("query_id", F.posexplode("hits").alias("pos", "h"))
    right = lists.select("query_id", F.posexplode("cites").alias("pos", "c"))
    return left.join(right, ["query_id", "pos"]).select("query_id", "pos", "h.doc_id", F.md5("c.title").alias("title"))


def evidence_groups(spark, d):
    """Hits by evidence group: the page of a source, or the chunk without its part."""
    rows = _hits(spark, d).withColumn("page", F.when(F.col("doc_id") % 2 == 0, F.col("chunk_index").cast("string")).otherwise(""))
    part = F.concat("path", F.when(F.col("chunk_index") > 0, F.concat(F.lit("__part_"), (F.col("chunk_index") + 1).cast("string"))).otherwise(""))
    key = F.when(F.col("page") != "", F.concat_ws("|", "path", F.lit("page"), "page")).otherwise(F.concat_ws("|", "path", F.lit("chunk"), F.regexp_replace(part, r"__part_\d+$", "")))
    return rows.groupBy("query_id", key.alias("evidence")).agg(F.count("*").alias("n"), F.min("rank").alias("best"))


def direct_replies(spark, d):
    """An extractive reply where every hit of a query fits its domain: title and year of the best; else none."""
    rows = _hits(spark, d).join(PR.indexed(spark, d).stats.select("doc_id", "chunk_index", "record_type", "source", "lang"), ["doc_id", "chunk_index"])
    every = rows.groupBy("query_id").agg(F.bool_and(PR._in_domain()).alias("fits"), F.min_by(F.struct("title", "effective_year"), "rank").alias("b"))
    reply = F.when(F.col("fits"), F.concat(F.lit("See "), "b.title", F.lit(" of "), F.col("b.effective_year").cast("string"), F.lit(".")))
    return every.select("query_id", "fits", reply.alias("reply"))


def query_payloads(spark, d):
    """The answer to each query as one JSON text."""
    hits = _hits(spark, d).filter("rank <= 3").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "chunk_index"))).alias("hits"))
    return hits.select("query_id", F.to_json(F.struct("query_id", "hits")).alias("payload"))


def turn_files(spark, d):
    """Each turn as a JSON record in a folder of its conversation, read back."""
    path = scratch(spark, "turns")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    rows.write.partitionBy("role").json(path)
    read = spark.read.schema("conv_id long, turn long, role string, chars long").json(path)
    return read.groupBy("role").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.count_distinct("conv_id").alias("conversations"))


def english_speech(spark, d):
    """Substitutions, plain thousands spelled out, sentences at the white space after their end."""
    c = F.regexp_replace(F.regexp_replace(F.col("text"), r"\b1,000\b", "one thousand"), r"\b[Ee]\.g\.", "for example")
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(c, r"(?<=[.!?])\s+")).alias("pos", "s")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.md5("s").alias("digest"))


@F.pandas_udf(StringType())
def _spoken(texts: pd.Series) -> pd.Series:
    return texts.map(READ_ALOUD, na_action="ignore")


def spoken_dates(spark, d):
    """The date of each order as it is read: year, month and day, the irregular days included."""
    written = F.concat(F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月"), F.dayofmonth("o_orderdate"), F.lit("日"))
    orders = table(spark, d, "orders").select("o_orderkey", written.alias("written"))
    read = orders.select("written").distinct().withColumn("spoken", _spoken("written"))
    return orders.join(read, "written", "left").select("o_orderkey", "spoken")


def spoken_quantities(spark, d):
    """Quantities, places and discounts of line items as they are read with their counters."""
    n = lambda c: c.cast("int").cast("string")
    written = F.concat(n(F.col("l_quantity")), F.lit("本、"), n(F.col("l_linenumber")), F.lit("階、"), n(F.round(F.col("l_discount") * 100)), F.lit("%"))
    each = table(spark, d, "lineitem").groupBy(written.alias("written")).agg(F.count("*").alias("n"))
    return each.withColumn("spoken", _spoken("written"))


def furigana(spark, d):
    """Written words with their reading in brackets are read once; nested brackets are opened, labels end in a comma."""
    c = F.concat(F.lit("東京（とうきょう）: "), F.coalesce("lang", F.lit("")), F.lit(" ((a (b))) "), F.col("doc_id").cast("string"))
    c = F.regexp_replace(c, "[一-鿿々]+（([ぁ-ゖー]+)）", "$1")
    c = F.regexp_replace(c, "([ぁ-ゖ]): ", "$1、")
    for _ in range(3):
        c = F.regexp_replace(c, r"\(([^()]*)\)", "、$1、")
    return documents(spark, d).select("doc_id", F.regexp_replace(c, "(、 ?)+", "、").alias("spoken"))


def mono_pcm(spark, d):
    """Vectors as two-channel signals: mixed to one, scaled into range where they leave it, coded in 16 bits."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("x"))
    pairs = F.sequence(F.lit(0), (F.size("x") / 2).cast("int") - 1)
    mono = F.transform(pairs, lambda i: (F.element_at("x", 2 * i + 1) + F.element_at("x", 2 * i + 2)) / 2)
    v = v.select("vec_id", F.transform(mono, lambda y: F.when(F.isnan(y), 0.0).otherwise(y)).alias("m"))
    peak = F.greatest(F.array_max(F.transform("m", lambda y: F.abs(y))), F.lit(1.0))
    pcm = F.transform("m", lambda y: F.bround(y / peak * 32767).cast("long"))
    return v.select("vec_id", F.size("m").cast("long").alias("samples"), F.aggregate(pcm, F.lit(0).cast("long"), lambda a, s: a + F.abs(s)).alias("level"))


def early_pauses(spark, d):
    """Silences of two frames begin an early result: used if a third follows, void if speech resumes."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").withColumn("on", F.abs("value") >= 50.0).withColumn("run", F.sum(F.col("on").cast("int")).over(w))
    silent = rows.filter(~F.col("on") & (F.col("run") > 0)).groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return silent.groupBy("user_id").agg(F.count_if(F.col("n") >= 2).alias("begun"), F.count_if(F.col("n") == 2).alias("void_or_open"), F.count_if(F.col("n") >= 3).alias("used"))


def relayed(spark, d):
    """Events up to each user's first error, by kind: the relay stops there and tells why."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "events").withColumn("ended", F.coalesce(F.max(F.col("event_type").isin(*OUTAGE).cast("int")).over(w), F.lit(0)))
    kept = rows.filter("ended = 0")
    return kept.groupBy("user_id").agg(F.count_if(~F.col("event_type").isin(*OUTAGE)).alias("relayed"), F.bool_or(F.col("event_type").isin(*OUTAGE)).alias("failed"))


def stream_segments(spark, d):
    """Speakable segments of conversations as they stream; every fifth conversation fails at its end."""
    rows = _with_last(spark, d, "conversations", "conv_id", "turn").withColumn("failed", F.col("conv_id") % 5 == 0)
    return drained(segment_stream(rows, "conv_id", "turn", "text", "ends", "failed"), "segments")


def stream_replies(spark, d):
    """Assistant messages as they stream, each a reply: sentences, a soft cut at 60 characters, the first clause early."""
    rows = _with_last(spark, d, "conversations", "conv_id", "turn").withColumn("failed", F.lit(False))
    return drained(segment_stream(rows, "conv_id", "turn", "text", "ends", "failed", S.REPLY), "replies")


def progressive_segments(spark, d):
    """Segments of whole messages, with other limits (Arrow batches)."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(S.segments_of(S.Rules(soft=32, hard=64, spaces=True))("text")).alias("pos", "segment"))


def stream_frames(spark, d):
    """Texts as byte streams, cut into frames of 60 bytes across messages."""
    rows = _with_last(spark, d, "conversations", "conv_id", "turn").withColumn("payload", F.encode("text", "UTF-8"))
    return drained(frame_stream(rows, "conv_id", "turn", "payload", 60), "frames").select("conv_id", "frame_no", F.hex("frame").alias("frame"))


QUERIES = {
    f.__name__: f
    for f in (
        normalized_queries, asr_replacements, content_terms, segmented_terms, query_locations, previous_messages, person_gate, provider_limits, transcript_gate, speakable, front_matter, prompt_bodies, validated_hosts, page_lines,
        link_labels, page_headings, bounded_hosts, category_pages, manifest_sources, source_url_mismatches, json_rows, without_known_bad, required_evidence, strict_domain, rule_boosts, evidence_text, expected_hits,
        zipped_citations, evidence_groups, direct_replies, query_payloads, turn_files, english_speech, spoken_dates, spoken_quantities, furigana, mono_pcm, early_pauses, relayed, stream_segments, stream_replies, progressive_segments, stream_frames,
    )
}

_U = "conversations WHERE role = 'user'"


def _replaced(c, rules):
    return reduce(lambda x, r: f"regexp_replace({x}, '{r[0]}', '{r[1]}', 'g')", rules, c)


def _in(words):
    return ", ".join(repr(w) for w in words)


_LEFT_OUT = reduce(lambda x, t: f"regexp_replace({x}, '(?is)<{t}[ >].*?</{t}>', ' ', 'g')", P.LEFT_OUT, "html")
_KINDS = {"guide_p0": "record_type = 'guide' AND source_priority = 'P0'", "future": "effective_year >= 2030", "french": "lang = 'fr'"}
_FIRST_RULE = ", ".join(f"CASE {' '.join(f'WHEN {c} THEN {p}' for _, m, c, p in BOOSTS if m == n)} END AS {n}_points" for n in dict.fromkeys(b[1] for b in BOOSTS))



_NOTED = """noted AS (SELECT doc_id, 'https://' || CASE doc_id % 3 WHEN 0 THEN 'www.example.com/' WHEN 1 THEN 'example.org/' ELSE 'other.net/' END || source AS source_url, lang AS record_type,
    CASE WHEN doc_id % 2 = 0 THEN '2026-01-02' ELSE '' END AS accessed, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE 'unknown_key: x' || chr(10) || 'publisher:' || chr(10) || coalesce(text, '') END AS body FROM documents)"""
_LITERALS = lambda words: ", ".join(f"'{w}'" for w in words.split())
#: 1992 to 2003
_SQL_YEARS = """せんきゅうひゃくきゅうじゅうに せんきゅうひゃくきゅうじゅうさん せんきゅうひゃくきゅうじゅうよ せんきゅうひゃくきゅうじゅうご せんきゅうひゃくきゅうじゅうろく せんきゅうひゃくきゅうじゅうなな
    せんきゅうひゃくきゅうじゅうはち せんきゅうひゃくきゅうじゅうきゅう にせん にせんいち にせんに にせんさん"""
_SQL_DAYS = """ついたち ふつか みっか よっか いつか むいか なのか ようか ここのか とおか じゅういちにち じゅうににち じゅうさんにち じゅうよっか じゅうごにち じゅうろくにち じゅうななにち じゅうはちにち じゅうくにち はつか
    にじゅういちにち にじゅうににち にじゅうさんにち にじゅうよっか にじゅうごにち にじゅうろくにち にじゅうななにち にじゅうはちにち にじゅうくにち さんじゅうにち さんじゅういちにち"""
SQL = {
    "asr_replacements": f"SELECT conv_id, turn, md5({_replaced('text', ASR_RULES)}) AS digest FROM {_U}",
    "content_terms": f"""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+') AS ws FROM {_U})
        SELECT conv_id, turn, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i AND length(x) >= 2 AND x NOT IN ({_in(STOP + PLACES)}) AND NOT regexp_full_match(x, '[0-9]+')), ' ') AS terms FROM w""",
    "query_locations": f"SELECT conv_id, turn, array_to_string(list_filter([{_in(PLACES)}], lambda p: contains(lower(text), p)), ',') AS places FROM {_U}",
    "previous_messages": f"""WITH b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM {_U})
        SELECT conv_id, turn, length(before) <= 40 AS joined, md5(CASE WHEN length(before) <= 40 THEN before || ' ' || text ELSE text END) AS digest FROM b""",
    "person_gate": f"SELECT conv_id, turn, coalesce(regexp_matches(text, '[A-Z][a-z]{{3,}} [A-Z][a-z]{{3,}}') AND NOT ({' OR '.join(f'contains(lower(text), {t!r})' for _, ts, _, _ in demo.INTENTS for t in ts)}), false) AS needs_check FROM {_U}",
    "provider_limits": f"SELECT conv_id, turn, CASE WHEN w THEN 10 ELSE 5 END AS rerank, CASE WHEN w THEN 10 ELSE 8 END AS candidates FROM (SELECT *, regexp_matches(lower(text), 'table|figure|chart|diagram') AS w FROM {_U})",
    "transcript_gate": f"""SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') IN ('thanksforwatching', 'hello', 'thankyou') THEN 'filler' WHEN length(trim(text)) > 1000 THEN 'too_long' ELSE 'accepted' END AS reason, count(*) AS n FROM {_U} GROUP BY 1""",
    "speakable": r"SELECT role, count(*) FILTER (regexp_matches(text, '[0-9A-Za-z\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{30FC}\x{4E00}-\x{9FFF}]')) AS speakable, count(*) AS n FROM conversations GROUP BY role",
    "front_matter": rf"""WITH {_NOTED} SELECT doc_id, source_url, record_type, CASE WHEN accessed = '' THEN '2026-06-30' ELSE accessed END AS accessed_date,
        CASE WHEN doc_id % 3 = 0 THEN 'Example Press' WHEN doc_id % 3 = 1 THEN 'Example Archive' ELSE '' END AS publisher, md5(trim(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(body, '^(\s*\n)+', '') ELSE body END, ' ')) AS body FROM noted""",
    "prompt_bodies": r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^\s*#|@|https?://')), chr(10)), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\n{2,}', chr(10), 'g') AS c FROM documents)
        SELECT doc_id, length(c) AS chars, md5(c) AS digest FROM c""",
    "validated_hosts": r"""SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'not_https' WHEN NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '(^|\.)example\.(com|org)$') THEN 'host' ELSE 'ok' END AS problem FROM pages""",
    "page_lines": rf"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_LEFT_OUT}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:{P.BREAKS})(?:[ /][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS c FROM pages),
        l AS (SELECT page_id, list_filter(list_transform(string_split(c, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS ls FROM c),
        t AS (SELECT page_id, array_to_string(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1]), chr(10)) AS text FROM l) SELECT page_id, length(text) AS chars, md5(text) AS digest FROM t WHERE length(text) >= 120""",
    "link_labels": r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s+href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hs, regexp_extract_all(html, '(?is)<a\s+href="([^"]*)"[^>]*>(.*?)</a>', 2) AS ls FROM pages)
        SELECT page_id, unnest(range(0, len(hs))) AS pos, unnest(hs) AS href, unnest(list_transform(ls, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g'))) AS label FROM l""",
    "page_headings": r"""SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace('## ' || regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g'), '^[# ]+', ''), ' $', ''), 160) AS heading FROM pages""",
    "bounded_hosts": f"SELECT host, least(count(*), {LIMIT})::BIGINT AS kept, count(*) > {LIMIT} AS more FROM (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) GROUP BY host",
    "category_pages": """SELECT page_id, category, list, row_number() OVER (PARTITION BY list ORDER BY page_id)::INT AS place FROM (SELECT page_id, lower(regexp_extract(url, '://[^/?#]*/([a-z]{2})/', 1)) AS category FROM pages) JOIN (VALUES ('en', 0), ('de', 1), ('fr', 2)) v(c, list) ON category = c""",
    "manifest_sources": "SELECT source AS source_id, 'https://' || source || '.example.org' AS url, min(doc_id) AS first, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY source",
    "source_url_mismatches": """SELECT 'src1' AS source_id, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE doc_id % 5 = 0 HAVING count(*) > 0""",
    "json_rows": """SELECT CASE WHEN doc_id % 11 = 0 THEN 'malformed' WHEN doc_id % 7 = 0 OR source IS NULL THEN 'source' ELSE 'ok' END AS problem, count(*) AS n, sum(CASE WHEN doc_id % 11 <> 0 THEN doc_id END)::BIGINT AS ids FROM documents GROUP BY 1""",
    "without_known_bad": "SELECT lang, count(*) FILTER (doc_id <> 1) AS kept, (SELECT count(*) FROM documents WHERE doc_id = 1) = 1 AS exactly_one FROM documents GROUP BY lang",
    "required_evidence": f"WITH {SQL_CATALOGUE} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, EXISTS (SELECT 1 FROM cat WHERE {p}) AS found" for k, p in _KINDS.items()),
    "strict_domain": f"WITH {SQL_CATALOGUE} SELECT lang, count(*) FILTER (CASE WHEN record_type = 'guide' THEN contains(title || ' ' || path, 'src1') ELSE record_type = 'profile' END) AS hits, count(*) AS n FROM cat GROUP BY lang",
    "rule_boosts": f"""WITH {SQL_CATALOGUE}, p AS (SELECT doc_id, {_FIRST_RULE} FROM cat) SELECT doc_id, (coalesce(type_points, 0) + coalesce(source_points, 0) + coalesce(status_points, 0))::BIGINT AS boost,
        ((type_points IS NOT NULL)::INT + (source_points IS NOT NULL)::INT + (status_points IS NOT NULL)::INT)::BIGINT AS rules FROM p WHERE coalesce(type_points, source_points, status_points) IS NOT NULL""",
    "evidence_text": f"{_HITS}, t AS (SELECT query_id, string_agg(body, ' ' ORDER BY rank) AS t FROM hits_ WHERE rank <= 5 GROUP BY query_id) SELECT query_id, length(t) AS chars, md5(t) AS digest FROM t",
    "expected_hits": f"""{_HITS} SELECT query_id, count(*) AS hits, count(*) FILTER (doc_id % 7 = 0 AND doc_id < 200) AS expected_hits, min(rank) FILTER (doc_id % 7 = 0 AND doc_id < 200) AS best FROM hits_ GROUP BY query_id""",
    "zipped_citations": f"{_HITS} SELECT query_id, rank - 1 AS pos, doc_id, md5(title) AS title FROM hits_",
    "evidence_groups": f"""{_HITS} SELECT query_id, CASE WHEN doc_id % 2 = 0 THEN path || '|page|' || chunk_index ELSE path || '|chunk|' || path END AS evidence, count(*) AS n, min(rank) AS best FROM hits_ GROUP BY ALL""",
    "direct_replies": f"""{_HITS}, h AS (SELECT h.*, c.record_type, c.source, c.lang FROM hits_ h JOIN chunks c ON h.doc_id = c.doc_id AND h.chunk_index = c.chunk_index),
        e AS (SELECT query_id, bool_and({PR._WANTED}) AS fits, arg_min(title, rank) AS title, arg_min(effective_year, rank) AS year FROM h GROUP BY query_id) SELECT query_id, fits, CASE WHEN fits THEN 'See ' || title || ' of ' || year || '.' END AS reply FROM e""",
    "query_payloads": f"""{_HITS} SELECT query_id, '{{"query_id":' || query_id || ',"hits":[' || string_agg('{{"rank":' || rank || ',"doc_id":' || doc_id || ',"chunk_index":' || chunk_index || '}}', ',' ORDER BY rank) || ']}}' AS payload FROM hits_ WHERE rank <= 3 GROUP BY query_id""",
    "turn_files": "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role",
    "english_speech": r"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\b1,000\b', 'one thousand', 'g'), '\b[Ee]\.g\.', 'for example', 'g') AS c FROM conversations),
        s AS (SELECT conv_id, turn, string_split(regexp_replace(c, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM c) SELECT conv_id, turn, unnest(range(0, len(s))) AS pos, md5(unnest(s)) AS digest FROM s""",
    "segmented_terms": r"""WITH RECURSIVE vocab AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) BETWEEN 2 AND 4)) AS v FROM benchmark),
        asked AS (SELECT conv_id, turn, list_distinct(ws) AS d, ws FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[ .,;:!?\n\t\r]+'), lambda w: regexp_full_match(w, '[a-z]{6,}')) AS ws FROM conversations WHERE role = 'user')),
        words AS (SELECT DISTINCT unnest(d) AS w FROM asked),
        reach AS (SELECT w, 0::BIGINT AS pos FROM words UNION SELECT r.w, r.pos + length(v) FROM reach r JOIN vocab ON substr(r.w, r.pos + 1, length(v)) = v),
        spelled AS (SELECT list(DISTINCT w) AS s FROM reach WHERE pos = length(w))
        SELECT conv_id, turn, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i AND NOT coalesce(list_contains(s, w), false)), ' ') AS terms FROM asked, spelled""",
    "spoken_dates": f"""SELECT o_orderkey, [{_LITERALS(_SQL_YEARS)}][(year(o_orderdate) - 1991)::INT] || 'ねん'
        || [{_LITERALS("いちがつ にがつ さんがつ しがつ ごがつ ろくがつ しちがつ はちがつ くがつ じゅうがつ じゅういちがつ じゅうにがつ")}][month(o_orderdate)::INT] || CASE day(o_orderdate) WHEN 1 THEN ' ' ELSE '' END
        || [{_LITERALS(_SQL_DAYS)}][day(o_orderdate)::INT] AS spoken FROM orders""",
    "spoken_quantities": f"""WITH t AS (SELECT l_quantity::INT AS q, l_linenumber::INT AS f, round(l_discount * 100)::INT AS p, count(*) AS n FROM lineitem GROUP BY ALL)
        SELECT q || '本、' || f || '階、' || p || '%' AS written, n, [{_LITERALS("じゅう にじゅう さんじゅう よんじゅう ごじゅう")}, ''][CASE WHEN q < 10 OR q % 10 = 0 THEN 6 ELSE q // 10 END]
        || CASE WHEN q % 10 = 0 THEN [{_LITERALS("じゅっぽん にじゅっぽん さんじゅっぽん よんじゅっぽん ごじゅっぽん")}][q // 10] ELSE [{_LITERALS("いっぽん にほん さんぼん よんほん ごほん ろっぽん ななほん はっぽん きゅうほん")}][q % 10] END
        || '、' || [{_LITERALS("いっかい にかい さんがい よんかい ごかい ろっかい ななかい")}][f] || '、' || [{_LITERALS("ぜろ いち に さん よん ご ろく なな はち きゅう じゅっ")}][p + 1] || 'ぱーせんと' AS spoken FROM t""",
    "furigana": "SELECT doc_id, 'とうきょう、' || coalesce(lang, '') || ' 、a 、b、' || doc_id AS spoken FROM documents",
    "mono_pcm": """WITH m AS (SELECT vec_id, list_transform(range(0, len(embedding) // 2), lambda i: (embedding[2 * i + 1]::DOUBLE * 4 + embedding[2 * i + 2]::DOUBLE * 4) / 2) AS m FROM embeddings),
        p AS (SELECT *, greatest(list_max(list_transform(m, lambda y: abs(y))), 1.0::DOUBLE) AS peak FROM m) SELECT vec_id, len(m) AS samples, list_sum(list_transform(m, lambda y: abs(round_even(y / peak * 32767, 0)::BIGINT)))::BIGINT AS level FROM p""",
    "early_pauses": """WITH r AS (SELECT user_id, abs(value) >= 50 AS is_on, sum((abs(value) >= 50)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events),
        s AS (SELECT user_id, run, count(*) AS n FROM r WHERE NOT is_on AND run > 0 GROUP BY ALL) SELECT user_id, count(*) FILTER (n >= 2) AS begun, count(*) FILTER (n = 2) AS void_or_open, count(*) FILTER (n >= 3) AS used FROM s GROUP BY user_id""",
    "relayed": """WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'error') AS stop FROM events GROUP BY user_id)
        SELECT e.user_id, count(*) FILTER (event_type <> 'error') AS relayed, bool_or(event_type = 'error') AS failed FROM events e JOIN f USING (user_id) WHERE stop IS NULL OR event_id <= stop GROUP BY e.user_id""",
    "stream_frames": """WITH h AS (SELECT conv_id, string_agg(hex(encode(text)), '' ORDER BY turn) AS x FROM conversations GROUP BY conv_id), s AS (SELECT *, unnest(range(0, length(x) // 120)) AS frame_no FROM h)
        SELECT conv_id, frame_no, substr(x, (frame_no * 120 + 1)::BIGINT, 120) AS frame FROM s""",
}
