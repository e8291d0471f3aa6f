"""Corpus scan, chunking and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking
from tessera.plans.common import SQL_CATALOGUE, SQL_CHUNKS, STRIP, chunks, documents
from tessera.session import table


def corpus_scan_stats(spark, d):
    docs = documents(spark, d)
    return docs.groupBy("lang", "source").agg(
        F.count("*").alias("seen"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) > 0).alias("indexed"),
        F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("skipped"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"),
    )


def normalize_text(spark, d):
    return documents(spark, d).select("doc_id", T.normalize(F.col("text")).alias("norm"))


def content_hash(spark, d):
    return documents(spark, d).select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("chars"))


def exact_dup_groups(spark, d):
    return chunking.duplicate_groups(documents(spark, d))


def chunk_windows(spark, d):
    return chunks(spark, d).select("doc_id", "chunk_index", F.col("start").cast("long").alias("start"), F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


def chunk_part_ids(spark, d):
    return chunking.part_ids(chunks(spark, d)).select("doc_id", "chunk_index", "chunk_id")


def doc_catalogue(spark, d):
    return chunking.catalogue(documents(spark, d)).drop("text")


def paragraph_chunks(spark, d):
    packed = chunking.pack_paragraphs(documents(spark, d).select("doc_id", "text"))
    return packed.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def markdown_sections(spark, d):
    rows = documents(spark, d).select("doc_id", F.posexplode(T.sections(F.col("text"))).alias("section", "s"))
    return rows.select("doc_id", F.col("section").cast("long").alias("section"), F.col("s.heading").alias("heading"), F.length("s.body").cast("long").alias("body_chars"))


def corpus_fingerprint(spark, d):
    return chunking.fingerprint(documents(spark, d))


def manifest_diff(spark, d):
    """Keys of documents against those of labels: what one side lacks."""
    a, b = documents(spark, d).select("doc_id", F.lit(1).alias("a")), table(spark, d, "labels").select("doc_id", F.lit(1).alias("b"))
    state = F.when(F.col("a").isNull(), "unknown").when(F.col("b").isNull(), "unlabelled").otherwise("both")
    return a.join(b, "doc_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def row_validation(spark, d):
    """The first rule that each document breaks, or null."""
    docs = documents(spark, d)
    reason = (
        F.when(F.col("text").isNull() | (F.length("text") < 40), "too_short").when(F.length("text") > 20000, "too_long").when(F.col("n_chars") != F.length("text"), "char_count")
        .when(~F.col("lang").isin("en", "de", "fr", "es"), "lang").when(~F.col("source").rlike("^src[0-9]+$"), "source")
    )
    return docs.select("doc_id", reason.alias("reason"))


def unique_keys(spark, d):
    """Keys of lineitem that repeat: none, if the constraint holds."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").count().filter("count > 1").agg(F.count("*").alias("repeated"))


def foreign_keys(spark, d):
    """Rows of each child table without their parent, counted."""
    line, orders, cust = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    one = line.join(orders, line.l_orderkey == orders.o_orderkey, "left_anti").agg(F.count("*").alias("missing")).select(F.lit("lineitem").alias("child"), "missing")
    two = orders.join(cust, orders.o_custkey == cust.c_custkey, "left_anti").agg(F.count("*").alias("missing")).select(F.lit("orders").alias("child"), "missing")
    return one.unionByName(two)


def first_source_lookup(spark, d):
    """Dimension lookup with a value comparison: orders by nation, and how many cost more than the customer owns."""
    orders, cust, nation = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = orders.join(cust, orders.o_custkey == cust.c_custkey).join(nation, cust.c_nationkey == nation.n_nationkey)
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > F.col("c_acctbal")).alias("over"))


def markdown_render(spark, d):
    """Each language and source as a Markdown index of its ten longest documents."""
    from pyspark.sql import Window

    rows = chunking.catalogue(documents(spark, d)).withColumn("rn", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.length("text").desc(), "doc_id"))).filter("rn <= 10")
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.length("text").cast("string"), F.lit(")"))
    lists = rows.groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("items"))
    return lists.select("lang", "source", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.array_join(F.transform("items", lambda x: x["line"]), "\n")).alias("markdown"))


QUERIES = {f.__name__: f for f in (corpus_scan_stats, normalize_text, content_hash, exact_dup_groups, chunk_windows, chunk_part_ids, doc_catalogue, paragraph_chunks, markdown_sections, corpus_fingerprint, manifest_diff, row_validation, unique_keys, foreign_keys, first_source_lookup, markdown_render)}

_FP = "sha256(concat_ws('|', doc_id::VARCHAR, length(text)::VARCHAR, sha256(text)))"
SQL = {
    "corpus_scan_stats": """SELECT lang, source, count(*) AS seen, count(*) FILTER (coalesce(length(text), 0) > 0) AS indexed, count(*) FILTER (coalesce(length(text), 0) = 0) AS skipped,
        sum(length(text))::BIGINT AS chars, max(length(text)) AS longest FROM documents GROUP BY ALL""",
    "normalize_text": rf"""SELECT doc_id, {STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS norm FROM documents""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash, length(text) AS chars FROM documents",
    "exact_dup_groups": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "chunk_windows": f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, start, md5(text) AS digest, length(text) AS chars FROM chunks",
    "chunk_part_ids": f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, path || CASE WHEN chunk_index > 0 THEN '__part_' || lpad((chunk_index + 1)::VARCHAR, 2, '0') ELSE '' END AS chunk_id FROM chunks",
    "doc_catalogue": f"WITH {SQL_CATALOGUE} SELECT * EXCLUDE (text) FROM cat",
    "markdown_sections": rf"""WITH parts AS (SELECT doc_id, regexp_split_to_array(chr(10) || text, '\n##[ \t]+') AS p FROM documents),
        each AS (SELECT doc_id, unnest(range(2, len(p) + 1)) AS i, p FROM parts WHERE len(p) > 1),
        cut AS (SELECT doc_id, i, {STRIP.format("split_part(p[i], chr(10), 1)")} AS heading, {STRIP.format(r"regexp_replace(p[i], '^[^\n]*\n?', '')")} AS body FROM each)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS section, heading, length(body) AS body_chars FROM cut WHERE body <> ''""",
    "corpus_fingerprint": f"""WITH h AS (SELECT {_FP} AS x FROM documents), s AS (SELECT count(*) AS n, sum(('0x' || substr(x, 1, 15))::BIGINT) AS a, sum(('0x' || substr(x, 16, 15))::BIGINT) AS b FROM h)
        SELECT n, sha256(concat_ws('|', n::VARCHAR, a::VARCHAR, b::VARCHAR)) AS digest FROM s""",
    "manifest_diff": """SELECT CASE WHEN a.doc_id IS NULL THEN 'unknown' WHEN b.doc_id IS NULL THEN 'unlabelled' ELSE 'both' END AS state, count(*) AS n, min(coalesce(a.doc_id, b.doc_id)) AS first_id
        FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id GROUP BY 1""",
    "row_validation": """SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 40 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' WHEN n_chars <> length(text) THEN 'char_count'
        WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'lang' WHEN NOT regexp_matches(source, '^src[0-9]+$') THEN 'source' END AS reason FROM documents""",
    "unique_keys": "SELECT count(*) AS repeated FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "foreign_keys": """SELECT 'lineitem' AS child, count(*) AS missing FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
        UNION ALL SELECT 'orders', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""",
    "first_source_lookup": """SELECT n_name, count(*) AS orders, count(*) FILTER (o_totalprice > c_acctbal) AS over FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    "markdown_render": f"""WITH {SQL_CATALOGUE}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS rn FROM cat)
        SELECT lang, source, '# ' || source || chr(10) || chr(10) || string_agg('- ' || title || ' (' || length(text) || ')', chr(10) ORDER BY rn) AS markdown FROM r WHERE rn <= 10 GROUP BY lang, source""",
}
