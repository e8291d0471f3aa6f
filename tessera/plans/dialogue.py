"""Query understanding, conversations, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dialogue as D
from tessera.operators import retrieval as R
from tessera.plans.common import OVERLAP, SIZE, SQL_CATALOGUE, SQL_CHUNKS, documents
from tessera.plans import retrieval as PR
from tessera.operators import chunking
from tessera.rules import demo
from tessera.session import table
from tessera.streaming.run import written


def _turns(spark, d):
    return table(spark, d, "conversations")


def query_terms(spark, d):
    rows = _turns(spark, d).filter("role = 'user'").withColumn("low", T.single_line(F.lower("text")))
    words = F.filter(F.split("low", "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    return rows.select("conv_id", "turn", F.array_join(F.slice(F.array_distinct(words), 1, 12), " ").alias("terms"))


def query_intents(spark, d):
    rows = D.route(_turns(spark, d).filter("role = 'user'"))
    return rows.select("conv_id", "turn", F.array_join("intents", ",").alias("intents"))


def query_domain(spark, d):
    rows = D.route(_turns(spark, d).filter("role = 'user'"))
    return rows.groupBy("domain", "reason").agg(F.count("*").alias("n"))


def route_decision(spark, d):
    return D.route(_turns(spark, d).filter("role = 'user'")).select("conv_id", "turn", "routed", "domain", "reason")


def last_user_message(spark, d):
    return D.last_of_role(_turns(spark, d))


def history_window(spark, d):
    return D.recent(_turns(spark, d), 3).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"), F.col("back").cast("int").alias("back"))


def turn_pairs(spark, d):
    return D.paired(_turns(spark, d))


def followup_resolve(spark, d):
    return D.resolve_followups(_turns(spark, d)).select("conv_id", "turn", "follows", F.md5("resolved").alias("digest"))


def _hits(spark, d):
    """The top hits with what evidence needs; bodies are read for these alone."""
    index = PR.indexed(spark, d)
    top = R.diversified(PR._scored(index), ["doc_id"], 10)
    # ten rows a query at most, written so that the two joins do not search twice
    top = F.broadcast(written(top.select("query_id", "doc_id", "chunk_index", "path", "score", F.col("place").alias("rank"), "source_priority"), "top-hits"))
    found = chunking.catalogue(documents(spark, d).join(top.select("doc_id").distinct(), "doc_id", "left_semi"))
    body = chunking.chunk_windows(found, SIZE, OVERLAP).select("doc_id", "chunk_index", "title", F.col("text").alias("body"), "temporal_status", "effective_year")
    return body.join(top, ["doc_id", "chunk_index"])


def citations(spark, d):
    rows = _hits(spark, d).withColumn("citation_id", F.concat("path", F.lit("#"), "title", F.lit(":"), F.col("chunk_index").cast("string")))
    return rows.select("query_id", "rank", "citation_id", "title", "score", F.col("effective_year").cast("int").alias("year"))


def citation_uniqueness(spark, d):
    rows = citations(spark, d)
    return rows.groupBy("query_id").agg((F.count("citation_id") == F.count_distinct("citation_id")).alias("is_unique"), F.count("*").alias("n"))


def temporal_evidence_filter(spark, d):
    """Of each query's hits the current ones, if it has any."""
    rows = _hits(spark, d).withColumn("current", F.col("temporal_status").startswith("current"))
    some = rows.groupBy("query_id").agg(F.bool_or("current").alias("some"))
    return rows.join(some, "query_id").filter("current or not some").select("query_id", "rank", "doc_id", "temporal_status")


def context_budget(spark, d):
    rows = _hits(spark, d).withColumn("header", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title")))
    packed = D.budgeted(rows, 3000)
    return packed.select("query_id", "rank", F.md5("packed").alias("digest"), F.length("packed").cast("long").alias("chars"))


def temporal_boosts(spark, d):
    """Points of each document for questions that name no year, some years, plans or results."""
    docs = chunking.catalogue(documents(spark, d))
    for name, (years, plans, results) in demo.ASKED.items():
        asked = docs.withColumns({"asked": F.array(*map(F.lit, years)).cast("array<int>"), "wants_plan": F.lit(plans), "wants_result": F.lit(results)})
        year = F.expr("case " + " ".join(f"when {c} then {n}" for c, n in demo.YEAR_POINTS) + " end")
        docs = asked.withColumn(name, D.rule_points(demo.STATUS_POINTS, F.col("temporal_status"), year).cast("int")).drop("asked", "wants_plan", "wants_result")
    return docs.select("doc_id", *demo.ASKED)


def confidence_gate(spark, d):
    """Acceptance of each query from coverage of its terms by any hit, a term in a title, priority and margin."""
    terms = {q: [t for x, t in R.split_terms() if x == q] for q, _ in demo.QUERIES}
    hits = _hits(spark, d)
    rows = F.lit(None).cast("array<string>")
    for q, found in terms.items():
        rows = F.when(F.col("query_id") == q, F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")).otherwise(rows)
    each = hits.withColumn("term", F.explode(rows)).groupBy("query_id", "term").agg(F.max(F.lower("body").contains(F.col("term")).cast("int")).alias("covered"))
    coverage = each.groupBy("query_id").agg(F.avg("covered").alias("coverage"))
    anchor = hits.groupBy("query_id").agg(F.bool_or(F.exists(rows, lambda t: F.lower("title").contains(t))).cast("int").alias("anchor"))
    best = hits.groupBy("query_id").agg(F.max("score").alias("top"), F.bool_or(F.col("source_priority") == "P0").cast("int").alias("p0"), F.max_by("doc_id", -F.col("rank")).alias("doc_id"))
    out = best.join(coverage, "query_id").join(anchor, "query_id").withColumn("confidence", F.round(D.confidence(F.col("coverage"), F.col("anchor"), F.col("p0"), (F.col("top") >= 40).cast("int")), 6))
    gate = F.when(F.col("top") < 12, "low_score").when(F.col("coverage") == 0, "no_content").when(F.col("confidence") < 0.68, "low_confidence").otherwise("accepted")
    return out.select("query_id", "doc_id", F.round("coverage", 6).alias("coverage"), "confidence", gate.alias("gate"))


def event_dates(spark, d):
    """Valid ISO dates in texts, and whether the last lies before a given day."""
    rows = documents(spark, d).select("doc_id", D.dates_in(F.coalesce("text", F.lit(""))).alias("dates")).filter(F.size("dates") > 0)
    return rows.select("doc_id", F.size("dates").cast("long").alias("n"), F.array_min("dates").alias("first"), F.array_max("dates").alias("last"), (F.array_max("dates") < F.lit("2026-01-01").cast("date")).alias("ended"))


def guidance_sentences(spark, d):
    """Sentences of each document that hold an action word and a marker."""
    sentences = F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+")
    kept = F.filter(sentences, lambda s: T.contains_any(F.lower(s), ["license", "contact", "email"]) & T.contains_any(F.lower(s), ["the ", "version", "@"]))
    return documents(spark, d).select("doc_id", F.size(kept).cast("long").alias("n")).filter("n > 0")


QUERIES = {f.__name__: f for f in (query_terms, query_intents, query_domain, route_decision, last_user_message, history_window, turn_pairs, followup_resolve, citations, citation_uniqueness, temporal_evidence_filter, context_budget, temporal_boosts, confidence_gate, event_dates, guidance_sentences)}

_LINE = r"regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _any(col, terms):
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


_ONE = ", ".join(f"CASE WHEN {_any('compact', t)} THEN '{i}' END" for i, t, _, s in demo.INTENTS if s == 1)
_TWO = ", ".join(f"CASE WHEN {_any('compact', t)} AND list_contains(one, '{n}') THEN '{i}' END" for i, t, n, s in demo.INTENTS if s == 2)
_BY_INTENT = "CASE " + " ".join(f"WHEN list_has_any(intents, {n!r}) THEN '{dom}'" for _, dom, n in demo.DOMAINS) + " END"
_BY_WORD = "CASE " + " ".join(f"WHEN contains(compact, '{w}') THEN '{dom}'" for _, w, dom in demo.KEYWORDS) + " END"
_ROUTE = f"""WITH u AS (SELECT *, lower({_LINE}) AS compact FROM conversations WHERE role = 'user'),
  i1 AS (SELECT *, list_filter([{_ONE}], lambda x: x IS NOT NULL) AS one FROM u),
  i2 AS (SELECT *, list_sort(one || list_filter([{_TWO}], lambda x: x IS NOT NULL)) AS intents FROM i1),
  r1 AS (SELECT *, CASE WHEN compact = '' THEN 'empty' WHEN compact IN ({", ".join(repr(t) for t in demo.TRIVIAL)}) THEN 'greeting' END AS early, {_BY_INTENT} AS by_intent, {_BY_WORD} AS by_word FROM i2),
  routed AS (SELECT *, coalesce(early, CASE WHEN by_intent IS NOT NULL THEN 'intent' END, CASE WHEN by_word IS NOT NULL THEN 'keyword' END, 'outside') AS reason,
    CASE WHEN early IS NULL THEN coalesce(by_intent, by_word) END AS domain FROM r1)"""
_HITS = f"""{PR._RANKED}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) > 1 AS later FROM ranked),
  p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, rank)::INT AS place FROM g),
  hits_ AS (SELECT p.query_id, p.doc_id, p.chunk_index, c.path, p.score, p.place AS rank, c.source_priority, c.title, c.text AS body, c.temporal_status, c.effective_year
    FROM p JOIN chunks c ON p.doc_id = c.doc_id AND p.chunk_index = c.chunk_index WHERE place <= 10)"""
_CIT = f"{_HITS}, cit AS (SELECT query_id, rank, path || '#' || title || ':' || chunk_index AS citation_id, title, score, effective_year::INT AS year FROM hits_)"


def _boost(years, plans, results):
    sql = lambda c: c.replace("size(asked)", str(len(years))).replace("array_contains(asked, effective_year)", f"effective_year IN ({', '.join(map(str, years)) or 'NULL'})").replace("wants_plan", str(plans)).replace("wants_result", str(results))
    year = "(CASE " + " ".join(f"WHEN {sql(c)} THEN {n}" for c, n in demo.YEAR_POINTS) + " END)"
    return "(CASE " + " ".join(f"WHEN regexp_full_match(temporal_status, '{p}') AND {sql(c)} THEN {f'{year} + ' if adds else ''}{n}" for p, c, n, adds in demo.STATUS_POINTS) + f" ELSE {year} END)::INT"


SQL = {
    "query_terms": rf"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower({_LINE}), '[^a-z0-9]+'), lambda w: length(w) >= 2) AS ws FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, array_to_string(list_slice(list_filter(ws, lambda x, i: list_position(ws, x) = i), 1, 12), ' ') AS terms FROM w""",
    "query_intents": f"{_ROUTE} SELECT conv_id, turn, array_to_string(intents, ',') AS intents FROM routed",
    "query_domain": f"{_ROUTE} SELECT domain, reason, count(*) AS n FROM routed GROUP BY ALL",
    "route_decision": f"{_ROUTE} SELECT conv_id, turn, domain IS NOT NULL AS routed, domain, reason FROM routed",
    "last_user_message": "SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "history_window": """SELECT conv_id, turn, role, length(text) AS chars, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS back FROM conversations) WHERE back <= 3""",
    "turn_pairs": """SELECT conv_id, turn, text, reply FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND nr = 'assistant'""",
    "followup_resolve": f"""{_ROUTE}, a AS (SELECT *, last_value(CASE WHEN reason = 'intent' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM routed),
        f AS (SELECT *, length(text) <= 80 AND {_any("lower(text)", demo.FOLLOWUP)} AND reason <> 'intent' AND anchor IS NOT NULL AS follows FROM a)
        SELECT conv_id, turn, follows, md5(CASE WHEN follows THEN anchor || ' ' || text ELSE text END) AS digest FROM f""",
    "citations": f"{_CIT} SELECT * FROM cit",
    "citation_uniqueness": f"{_CIT} SELECT query_id, count(citation_id) = count(DISTINCT citation_id) AS is_unique, count(*) AS n FROM cit GROUP BY query_id",
    "temporal_evidence_filter": f"""{_HITS}, f AS (SELECT *, bool_or(starts_with(temporal_status, 'current')) OVER (PARTITION BY query_id) AS any_in FROM hits_)
        SELECT query_id, rank, doc_id, temporal_status FROM f WHERE starts_with(temporal_status, 'current') OR NOT any_in""",
    "context_budget": rf"""{_HITS}, h AS (SELECT *, '[' || rank || '] ' || title AS header FROM hits_ WHERE length(body) > 0),
        b AS (SELECT *, 3000 - coalesce(sum(length(header) + length(body) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - length(header) - 8 AS lefts FROM h),
        c AS (SELECT *, CASE WHEN length(body) > lefts THEN regexp_replace(substr(body, 1, (lefts - 1)::BIGINT), '\s+$', '') || '...' ELSE body END AS packed FROM b WHERE lefts > 0)
        SELECT query_id, rank, md5(packed) AS digest, length(packed) AS chars FROM c""",
    "temporal_boosts": f"WITH {SQL_CATALOGUE} SELECT doc_id, {", ".join(f"{_boost(*a)} AS {n}" for n, a in demo.ASKED.items())} FROM cat",
    "confidence_gate": f"""{_HITS}, e AS (SELECT h.query_id, t.term, max(contains(lower(body), t.term)::INT) AS covered FROM hits_ h JOIN terms t ON h.query_id = t.query_id GROUP BY ALL),
        cv AS (SELECT query_id, avg(covered) AS coverage FROM e GROUP BY query_id),
        an AS (SELECT h.query_id, bool_or(contains(lower(title), t.term))::INT AS anchor FROM hits_ h JOIN terms t ON h.query_id = t.query_id GROUP BY ALL),
        tops AS (SELECT query_id, max(score) AS top, bool_or(source_priority = 'P0')::INT AS p0, arg_min(doc_id, rank) AS doc_id FROM hits_ GROUP BY query_id),
        o AS (SELECT *, round(least(1, 0.45::DOUBLE + 0.25::DOUBLE * coverage + 0.15::DOUBLE * anchor + 0.1::DOUBLE * p0 + 0.05::DOUBLE * (top >= 40)::INT), 6) AS confidence FROM tops JOIN cv USING (query_id) JOIN an USING (query_id))
        SELECT query_id, doc_id, round(coverage, 6) AS coverage, confidence, CASE WHEN top < 12 THEN 'low_score' WHEN coverage = 0 THEN 'no_content' WHEN confidence < 0.68::DOUBLE THEN 'low_confidence' ELSE 'accepted' END AS gate FROM o""",
    "event_dates": r"""WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '\b(\d{4}-\d{2}-\d{2})\b', 1), lambda s: try_cast(s AS DATE)), lambda v: v IS NOT NULL) AS dates FROM documents)
        SELECT doc_id, len(dates) AS n, list_min(dates) AS first, list_max(dates) AS last, list_max(dates) < DATE '2026-01-01' AS ended FROM x WHERE len(dates) > 0""",
    "guidance_sentences": rf"""SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+'), lambda s: {_any("lower(s)", ["license", "contact", "email"])} AND {_any("lower(s)", ["the ", "version", "@"])})) AS n FROM documents) WHERE n > 0""",
}
