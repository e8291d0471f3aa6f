"""Speech text: verbalised symbols, mora estimate, duration, segments, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = "".join(chr(0xFF01 + i) for i in range(94))
HALF = "".join(chr(0x21 + i) for i in range(94))
# fixed values of the spoken length, in tenths of a mora: letter names by letter (others 20), kana, kanji, small letters, digits, pauses
LETTER_TENTHS = (("HRZ", 30), ("WX", 40))
SMALL_KANA = "ゃゅょぁぃぅぇぉゎャュョァィゥェォヮ"
PAUSES = "、，,。．！？!?"
#: (pattern, replacement) in order
SYMBOLS = [("%", " percent "), ("&", " and "), (r"\+", " plus "), ("=", " equals ")]
MARKDOWN = [(r"(?s)```.*?```", " "), (r"`([^`]*)`", "$1"), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"https?://[^ \n]+", "link"), (r"(?m)^[ \t]*(?:#+|[-*>])[ \t]+", ""), (r"\*\*([^*]*)\*\*", "$1")]


def fold_width(c: Column) -> Column:
    return F.replace(F.translate(c, FULL, HALF), F.lit("　"), F.lit(" "))


def normalize_speech(c: Column) -> Column:
    """Width folded, Markdown and URLs stripped, symbols in words, white space folded."""
    c = fold_width(F.coalesce(c, F.lit("")))
    for pattern, to in MARKDOWN + SYMBOLS:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^ | $", "")


def mora_tenths(c: Column) -> Column:
    """Rough spoken length in tenths of a mora: kana 10, kanji 17, the zero sign 20, digits 15, small letters 10, capitals their names, pauses inside the text 20."""
    c = F.translate(c, FULL, HALF)
    count = lambda x, chars: F.regexp_count(x, F.lit(f"[{chars}]"))
    kana = count(c, r"\x{3041}-\x{3096}\x{30A1}-\x{30FA}ー") - count(c, SMALL_KANA)
    inside = F.regexp_replace(c, r"(?U)[^\s]\s*$", "")
    letters = count(c, "A-Z") * 20 + sum(count(c, chars) * (tenths - 20) for chars, tenths in LETTER_TENTHS)
    return kana * 10 + count(c, r"\x{4E00}-\x{9FFF}々") * 17 + count(c, "〇") * 20 + letters + count(c, "a-z") * 10 + count(c, "0-9") * 15 + count(inside, PAUSES) * 20


def max_seconds(tenths: Column) -> Column:
    """clamp(0.7 + mora / 6, 1.2, 30), three decimals half to even"""
    return F.bround(F.least(F.greatest(F.lit(0.7) + tenths / 60.0, F.lit(1.2)), F.lit(30.0)), 3)


def sentences(c: Column) -> Column:
    """Runs that end in sentence punctuation or a line break, stripped; pieces without a letter or digit are dropped."""
    parts = F.regexp_extract_all(c, F.lit(r"[^.!?\n]+[.!?\n]*"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s.rlike(r"[0-9A-Za-z\x80-\x{10FFFF}]"))


def coalesce_tail(parts: Column, most: int) -> Column:
    """At most ``most`` segments: the last takes all that are left."""
    return F.when(F.size(parts) <= most, parts).otherwise(F.concat(F.slice(parts, 1, most - 1), F.array(F.array_join(F.slice(parts, F.lit(most), F.size(parts)), " "))))
