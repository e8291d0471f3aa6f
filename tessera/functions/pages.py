"""Text and links of pages, and metadata lines of documents, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose content is no text of the page's own.
LEFT_OUT = ("script", "style", "head", "nav", "footer", "aside", "form")
#: Elements that end a line.
BREAKS = "p|h[1-6]|div|li|tr|br|section|article"


def main_lines(html: Column) -> Column:
    """Array of the lines of a page without the elements that are left out; white space folded, equal neighbours once."""
    c = html
    for tag in LEFT_OUT:
        c = F.regexp_replace(c, rf"(?is)<{tag}[ >].*?</{tag}>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), rf"(?i)</?(?:{BREAKS})(?:[ /][^>]*)?>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f]+", " "), "^ | $", "")), lambda x: x != "")
    return F.filter(lines, lambda x, i: (i == 0) | (x != F.try_element_at(lines, F.greatest(i, F.lit(1)))))


def labelled_links(html: Column) -> Column:
    """Array of (href, label) in page order; labels without tags, white space folded."""
    pattern = F.lit(r'(?is)<a\s+href="([^"]*)"[^>]*>(.*?)</a>')
    labels = F.transform(F.regexp_extract_all(html, pattern, F.lit(2)), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "), "^ | $", ""))
    return F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("href"), labels.alias("label"))


def safe_heading(c: Column, most: int = 160) -> Column:
    """One line without leading marks of headings, cut to ``most`` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[# ]+", ""), " $", ""), F.lit(most))


def front_matter(text: Column, keys: tuple[str, ...]) -> Column:
    """struct(meta map, body): ``key: value`` lines of the given keys before anything else; any other line that is not blank begins the body."""
    known = "|".join(keys)
    lines = F.split(text, "\n")
    is_meta = lambda x: F.trim(x).rlike(rf"^(?:{known}):")
    first = F.aggregate(F.transform(lines, lambda x, i: F.when(is_meta(x) | (F.trim(x) == ""), None).otherwise(i)), F.lit(None).cast("int"), lambda a, x: F.coalesce(a, x))
    first = F.coalesce(first, F.size(lines))
    head = F.filter(F.slice(lines, F.lit(1), first), is_meta)
    entry = lambda x: F.struct(F.regexp_extract(F.trim(x), r"^([A-Za-z_]+):", 1).alias("key"), F.trim(F.regexp_extract(F.trim(x), r"^[A-Za-z_]+:\s*(.*)$", 1)).alias("value"))
    rest = F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0)))
    return F.struct(F.transform(head, entry).alias("meta"), F.trim(F.array_join(rest, "\n")).alias("body"))
