"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end, ideographic space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """LF line ends, one space for runs of spaces and tabs, at most one blank line, stripped."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def single_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def title_or(text: Column, fallback: Column) -> Column:
    """The first line that starts with ``#``, without its marks; else ``fallback``."""
    found = strip(F.regexp_extract(text, r"(?m)^[ \t]*#+[ \t]*(.+)$", 1))
    return F.when(found != "", found).otherwise(fallback)


def windows(c: Column, size: int = 900, overlap: int = 120) -> Column:
    """Array of overlapping windows at every multiple of size - overlap, stripped; empty ones are dropped.

    The last window may lie wholly inside the one before.
    """
    step = max(1, size - overlap)
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), strip(F.substring(c, s + 1, F.lit(size))).alias("text")))
    return F.filter(cut, lambda w: F.length(w["text"]) > 0)


def sections(c: Column) -> Column:
    """Array of (heading, body) of ``## `` sections; those without a body are dropped."""
    split = F.split(F.concat(F.lit("\n"), c), r"\n##[ \t]+")
    parts = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))
    cut = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "\n", 1)).alias("heading"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))
    return F.filter(cut, lambda s: s["body"] != "")


def replace_rules(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Folds (pattern, replacement) rules over ``c`` in order."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(t) for t in terms), F.lit(False))


def has_term(haystack: Column, term: Column) -> Column:
    """ASCII terms match whole words only, others as substrings; both lower-cased."""
    low, t = F.lower(haystack), F.lower(term)
    word = F.regexp_like(low, F.concat(F.lit(r"(?<![0-9a-z_])\Q"), t, F.lit(r"\E(?![0-9a-z_])")))
    return F.when(F.regexp_like(t, F.lit(r"^[\x00-\x7f]+$")), word).otherwise(low.contains(t))


def query_terms(c: Column, least: int = 2, most: int = 12) -> Column:
    """Lower-cased terms of at least ``least`` characters, each once, in order of first appearance."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9\p{L}]+"), lambda w: F.length(w) >= least)
    return F.slice(F.array_distinct(words), 1, most)


def strip_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", "")


def first_intents(compact: Column, rules) -> Column:
    """Sorted array of the intents of pass 1 and 2 whose terms occur in ``compact``."""
    one = [F.when(contains_any(compact, terms), F.lit(i)) for i, terms, needs, step in rules if step == 1]
    found = F.array_compact(F.array(*one))
    two = [F.when(contains_any(compact, terms) & F.array_contains(found, needs), F.lit(i)) for i, terms, needs, step in rules if step == 2]
    return F.array_sort(F.concat(found, F.array_compact(F.array(*two))) if two else found)


def first_domain(intents: Column, rules) -> Column:
    """The domain of the first rule that shares an intent; else null."""
    out = F.lit(None).cast("string")
    for _, domain, needed in sorted(rules, reverse=True):
        out = F.when(F.arrays_overlap(intents, F.array(*map(F.lit, needed))), domain).otherwise(out)
    return out
