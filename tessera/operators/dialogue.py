"""Conversations: routing, follow-ups, history, evidence for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.rules import demo


def route(messages: DataFrame, intents=demo.INTENTS, domains=demo.DOMAINS, keywords=demo.KEYWORDS, trivial=demo.TRIVIAL) -> DataFrame:
    """Adds intents, domain, reason and routed.  Empty and trivial texts exit early; then intents, then keywords in order."""
    low = F.lower(T.single_line(F.col("text")))
    rows = messages.withColumn("compact", low).withColumn("intents", T.first_intents(F.col("compact"), intents))
    by_word = F.lit(None).cast("string")
    for _, word, domain in sorted(keywords, reverse=True):
        by_word = F.when(F.col("compact").contains(word), domain).otherwise(by_word)
    by_intent = T.first_domain(F.col("intents"), domains)
    early = F.when(F.col("compact") == "", "empty").when(F.col("compact").isin(*trivial), "greeting")
    rows = rows.withColumn("early", early).withColumn("by_intent", by_intent).withColumn("by_word", by_word)
    reason = F.coalesce("early", F.when(F.col("by_intent").isNotNull(), "intent"), F.when(F.col("by_word").isNotNull(), "keyword"), F.lit("outside"))
    rows = rows.withColumn("reason", reason).withColumn("domain", F.when(F.col("early").isNull(), F.coalesce("by_intent", "by_word")))
    return rows.withColumn("routed", F.col("domain").isNotNull()).drop("compact", "early", "by_intent", "by_word")


def resolve_followups(messages: DataFrame, markers=demo.FOLLOWUP, longest: int = 80) -> DataFrame:
    """user messages with ``resolved``: a follow-up is prefixed with the latest earlier one that routes on its own."""
    user = route(messages.filter(F.col("role") == "user"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(F.col("reason") == "intent", F.col("text")), ignorenulls=True).over(before)
    low = F.lower(F.col("text"))
    follows = (F.length("text") <= longest) & T.contains_any(low, markers) & (F.col("reason") != "intent")
    rows = user.withColumn("anchor", anchor).withColumn("follows", follows & F.col("anchor").isNotNull())
    return rows.withColumn("resolved", F.when(F.col("follows"), F.concat("anchor", F.lit(" "), "text")).otherwise(F.col("text")))


def last_of_role(messages: DataFrame, role: str = "user") -> DataFrame:
    return messages.filter(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def recent(messages: DataFrame, n: int = 16) -> DataFrame:
    return messages.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).filter(F.col("back") <= n)


def paired(messages: DataFrame) -> DataFrame:
    """Each user message with the reply right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    return rows.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "text", "reply")


def rule_points(rules, subject: Column, base: Column) -> Column:
    """``base`` and the points of the first rule that fits; ``base`` alone where none does.

    A rule is (pattern of the whole subject, condition, points, adds), condition
    and points being SQL over columns; where it does not add, its points stand
    alone.
    """
    out = base
    for pattern, condition, points, adds in reversed(rules):
        found = F.expr(points)
        out = F.when(subject.rlike(f"^(?:{pattern})$") & F.expr(condition), base + found if adds else found).otherwise(out)
    return out


def budgeted(hits: DataFrame, budget: int, header: str = "header", body: str = "body", used: int = 0) -> DataFrame:
    """Hits of each query in rank order while the budget lasts; the last body is cut to fit and ends in an ellipsis.

    Exact as a prefix sum of uncut lengths: once a body is cut nothing more fits.
    """
    cost = F.length(header) + F.length(body) + 2
    before = F.coalesce(F.sum(cost).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = hits.filter(F.length(body) > 0).withColumn("left", budget - used - before - F.length(header) - 8).filter("left > 0")
    cut = F.concat(F.regexp_replace(F.substring(body, F.lit(1), (F.col("left") - 1).cast("int")), r"\s+$", ""), F.lit("..."))
    return rows.withColumn("packed", F.when(F.length(body) > F.col("left"), cut).otherwise(F.col(body)))


def confidence(coverage: Column, anchored: Column, priority: Column, margin: Column) -> Column:
    """min(1, .45 + .25 coverage + .15 anchor + .1 priority + .05 margin)"""
    return F.least(F.lit(1.0), 0.45 + 0.25 * coverage + 0.15 * anchored + 0.1 * priority + 0.05 * margin)


def dates_in(c: Column) -> Column:
    """Array of the valid yyyy-mm-dd dates in a text; invalid ones are skipped."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1)), lambda x: F.try_to_date(x, "yyyy-MM-dd"))
    return F.array_compact(found)
