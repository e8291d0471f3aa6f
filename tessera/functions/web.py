"""URL and page functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track visitors, where callers name no others
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")


def canonical_url(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Lower-case scheme and host, no default port, no doubled slashes, no ``tracking`` or utm parameters, sorted query, no fragment; null unless http(s)."""
    bare = F.regexp_replace(url, r"#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).otherwise(F.regexp_replace(host, r":443$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*([^?]*)", 1), "/{2,}", "/")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~F.substring_index(p, "=", 1).isin(*tracking))
    tail = F.array_join(F.array_sort(query), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))
    return F.when(scheme.isin("http", "https") & (host != ""), whole)


def host_within(url: Column, domains: list[str]) -> Column:
    """Is the host one of ``domains`` or below one?"""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith("." + d)
    return out


def in_scope(url: Column, domains: list[str], prefixes: list[str], denied: tuple[str, ...] = (".jpg", ".png", ".zip")) -> Column:
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | path.startswith(p)
    ends = F.lit(False)
    for s in denied:
        ends = ends | path.endswith(s)
    return host_within(url, domains) & inside & ~ends


def page_chunk_id(category: Column, url: Column) -> Column:
    """Slug of the URL's last 72 characters and ten digits of its digest."""
    slug = F.regexp_replace(F.lower(F.regexp_replace(url, r"^[A-Za-z]+://", "")), "[^a-z0-9]+", "-")
    return F.concat(category, F.lit("-"), F.regexp_replace(F.right(slug, F.lit(72)), "^-+|-+$", ""), F.lit("-"), F.substring(F.sha2(url, 256), 1, 10))


def inner(html: Column, tag: str) -> Column:
    """Text of the first ``tag`` element, tags and white space folded; entities are left as they are."""
    body = F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "), "^ | $", "")


def links(html: Column) -> Column:
    """Array of link targets, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'<a\s+href="([^"]*)"'), F.lit(1)))
