"""Main content of pages and a crawl over their links, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import web
from tessera.functions.main_content import main_content as content
from tessera.operators import frontier
from tessera.plans.analytics import _LINKS
from tessera.session import table

DEPTH, BUDGET, LEAST = 3, 200, 300


def _texts(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", "html", content(F.col("html")).alias("m"))
    return rows.select("page_id", "url", "html", "m.title", F.array_join("m.lines", "\n").alias("text"), F.size("m.links").cast("long").alias("n_links"))


def main_content(spark, d):
    """Title, text and number of links of each page's main elements."""
    return _texts(spark, d).select("page_id", F.md5("title").alias("title"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), "n_links")


def crawl_budget(spark, d):
    """A crawl of each domain from its first URL; a link's word leads to the first page that has it, which may be another domain's, and a word of one page alone leads nowhere."""
    domain = lambda url: F.regexp_extract(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), r"([^.]+\.[^.]+)$", 1)
    rows = _texts(spark, d).filter(F.col("url").isNotNull()).withColumn("category", domain(F.col("url"))).filter("category <> ''")
    own = rows.groupBy("url", "category").agg(F.min(F.length("text")).cast("long").alias("chars"))
    held = table(spark, d, "pages").select("page_id", "url", domain(F.col("url")).alias("category"), F.explode(web.links(F.col("html"))).alias("href")).filter("category <> ''")
    targets = held.groupBy("href").agg(F.min_by("url", "page_id").alias("final_url"), F.count("*").alias("holders")).filter("holders > 1")
    named = held.select("category", "href").distinct().join(targets, "href").select(F.concat(F.lit("https://"), "category", "href").alias("url"), "final_url")
    pages = own.select("url", F.col("url").alias("final_url"), "chars").unionByName(named.join(own.select(F.col("url").alias("final_url"), "chars"), "final_url"))
    links = held.select("url", F.concat(F.lit("https://"), "category", "href").alias("href")).distinct()
    seeds = own.groupBy("category").agg(F.min("url").alias("url"))
    return frontier.crawl(pages.withColumn("error", F.lit(None).cast("string")), links, seeds, lambda category, url: domain(url) == category, DEPTH, BUDGET, LEAST, strict=False)


QUERIES = {f.__name__: f for f in (main_content, crawl_budget)}

_DECODED = lambda c: f"regexp_replace(replace(replace(replace({c}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g')"
_FOLD = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_TEXTS = rf"""a AS (SELECT page_id, url, html, coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '\s+', ' ', 'g') AS body FROM pages),
    b AS (SELECT page_id, url, html, {_FOLD(_DECODED("title"))} AS title, body, string_split(regexp_replace(regexp_replace(body, '</?(?:p|br|h1)>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS parts FROM a),
    c AS (SELECT page_id, url, html, title, body, list_filter(list_transform(parts, lambda x: {_FOLD(_DECODED("x"))}), lambda x: x <> '') AS ls FROM b),
    texts AS (SELECT page_id, url, html, title, array_to_string(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1]), chr(10)) AS text, len(regexp_extract_all(body, '<a ')) AS n_links FROM c)"""
_DOMAIN = r"regexp_extract(lower(regexp_extract(url, '://([^/?#]*)', 1)), '([^.]+\.[^.]+)$', 1)"
SQL = {
    "main_content": f"WITH {_TEXTS} SELECT page_id, md5(title) AS title, length(text) AS chars, md5(text) AS digest, n_links FROM texts",
    "crawl_budget": f"""WITH RECURSIVE {_TEXTS},
        own AS (SELECT url, {_DOMAIN} AS category, min(length(text)) AS chars FROM texts WHERE {_DOMAIN} <> '' GROUP BY 1, 2),
        held AS (SELECT page_id, url, category, unnest(hs) AS href FROM (SELECT page_id, url, {_DOMAIN} AS category, {_LINKS} AS hs FROM pages) WHERE category <> ''),
        targets AS (SELECT href, arg_min(url, page_id) AS final_url FROM held GROUP BY href HAVING count(*) > 1),
        known AS (SELECT url, url AS final_url, category, chars FROM own
            UNION ALL SELECT DISTINCT 'https://' || h.category || href, final_url, o.category, o.chars FROM held h JOIN targets USING (href) JOIN own o ON o.url = final_url),
        reached AS (SELECT category, min(url) AS url, 0 AS depth FROM own GROUP BY category
            UNION SELECT r.category, 'https://' || h.category || h.href, r.depth + 1 FROM reached r JOIN known k ON k.url = r.url JOIN held h ON h.url = k.final_url
            WHERE r.depth < {DEPTH} AND k.category = r.category AND k.chars >= {LEAST}),
        nearest AS (SELECT category, url, min(depth) AS depth FROM reached GROUP BY 1, 2),
        placed AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY depth, url) AS place FROM nearest)
        SELECT p.category, p.url, depth::INT AS depth, final_url, CASE WHEN k.url IS NULL THEN 'not found' WHEN k.category <> p.category THEN 'redirected out of scope' WHEN chars < {LEAST} THEN 'too short' END AS failure
        FROM placed p LEFT JOIN known k ON k.url = p.url WHERE place <= {BUDGET}""",
}
