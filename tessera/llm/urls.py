"""URL filtering: rules on host suffix and path prefix, then a list of canonical URLs.

The list is probed through a blocked Bloom filter first.  It has a block of 256
bits for every 16 listed URLs, up to ``MAX_BLOCKS`` (40 MB as rows), so what is
broadcast is bounded: a longer list lets more false positives through to the
exact hash join, which removes them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, written

#: Blocks of the filter, at most; each has WORDS words of 64 bits and is meant for PER_BLOCK URLs.
MAX_BLOCKS = 1 << 20
WORDS = 4
PER_BLOCK = 16
#: Bits set for each URL.
PROBES = 8
#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, query, fragment and a trailing slash; null where there is no host."""
    host, path = host_of(url), F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls.  Ties go to the first by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for kind, suffix, prefix in reversed(ordered):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name, verdict = F.when(fits, suffix + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _words(key: Column, probes: int) -> list[Column]:
    """The bits of one key, in each word of its block."""
    places = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64 * WORDS)) for i in range(probes)]
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))
    return [reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.floor(p / 64) == w, bit(p)).otherwise(F.lit(0).cast("long")) for p in places)) for w in range(WORDS)]


def blocks_for(listed: int) -> int:
    """The least power of two of blocks that holds so many URLs, up to MAX_BLOCKS."""
    return min(MAX_BLOCKS, 1 << max(0, -(-listed // PER_BLOCK) - 1).bit_length())


def bloom_filter(listed: DataFrame, key: str, blocks: int, probes: int = PROBES) -> DataFrame:
    """(block, w0..w3): at most ``blocks`` rows."""
    bits = listed.select(_block(F.col(key), blocks).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(_words(F.col(key), probes))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url).

    ``listed`` has blocked canonical URLs in its first column; repeats and nulls
    in it play no part.  A URL that no rule fits is blocked if it is listed.
    A null URL or one without ``://`` has empty host and path, fits no rule and
    is allowed.  Long URLs are judged whole; of rules that are equally long the
    first by name counts.  Repeated rows and null ids are each returned; other
    columns, whatever their names, play no part; an empty list blocks nothing,
    and an empty table gives an empty result.  ``blocks`` overrides the size of
    the filter.
    """
    known = listed.select(F.col(listed.columns[0]).cast("string").alias("listed")).filter("listed is not null").distinct()
    known = written(known, "urls-listed")
    blocks = blocks or blocks_for(known.count())
    bloom = bloom_filter(known, "listed", blocks)
    url = F.col("url").cast("string")
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select(F.col("page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canon"))
        .select("page_id", "host", "path", "canon", name.alias("rule"), verdict.alias("by_rule"))
        .withColumn("probe", F.when(F.col("by_rule").isNull(), F.col("canon")))
    )
    words = _words(F.col("probe"), PROBES)
    hit = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(w) == w for i, w in enumerate(words)))
    probed = judged.withColumn("block", F.when(F.col("probe").isNotNull(), _block(F.col("probe"), blocks))).join(F.broadcast(bloom), "block", "left")
    probed = probed.withColumn("maybe", F.coalesce(F.col("probe").isNotNull() & hit, F.lit(False)))
    out = ["page_id", "host", "path", "rule"]
    probed = written(probed.select(*out, "by_rule", "maybe", F.when(F.col("maybe"), F.col("probe")).alias("probe")), "urls-probed")
    clear = probed.filter("not maybe").select(*out, F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
    exact = probed.filter("maybe").join(known, F.col("probe") == F.col("listed"), "left")
    return clear.unionByName(exact.select(*out, F.when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict")))
