"""The registered queries of the corpus operators, one for each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import balltree, debruijn, html_density, merkle, mixing, packing, quality, rpforest, simhash, toxicity, urls, warc, whitening
from tessera.llm.common import crc32_text, table

#: Target weights by level; sources weigh more the longer their name.
DOMAIN = "concat('d', coalesce(try_cast(substr(source, 4) as int) % 4, 0))"
DOMAIN_WEIGHT = "case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end"
LANG_WEIGHT = "case lang when 'en' then 5 when 'de' then 3 else 2 end"
SOURCE_WEIGHT = "1 + length(source) % 3"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP2 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
  d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
  f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {warc.MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to FROM d LEFT JOIN f USING (payload_digest)"""


def mixing_weights() -> dict:
    return {"domain": F.expr(DOMAIN_WEIGHT), "lang": F.expr(LANG_WEIGHT), "source": F.expr(SOURCE_WEIGHT)}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", F.expr(DOMAIN))
    return mixing.mix(docs, mixing_weights())


def _allot_sql(source: str, parent: str, child: str, out: str) -> str:
    """The water filling of one level, as SQL over ``source`` (parent, child, weight, held, budget)."""
    order = f"PARTITION BY {parent} ORDER BY held / weight, {child}"
    return f"""
  {out}_a AS (SELECT *, budget - coalesce(sum(held) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lefts,
    sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {source}),
  {out}_b AS (SELECT *, held::HUGEINT * weights <= lefts::HUGEINT * weight AS filled FROM {out}_a),
  {out}_c AS (SELECT *, max(CASE WHEN NOT filled THEN lefts END) OVER (PARTITION BY {parent}) AS rest,
    max(CASE WHEN NOT filled THEN weights END) OVER (PARTITION BY {parent}) AS over_w,
    sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reach FROM {out}_b),
  {out} AS (SELECT * EXCLUDE (budget, lefts, weights, filled, rest, over_w, reach),
    (CASE WHEN filled THEN held ELSE (rest * reach) // over_w - (rest * (reach - weight)) // over_w END)::BIGINT AS share FROM {out}_c)"""


def _sql_op3() -> str:
    percent, epochs, seed = mixing.BUDGET_PERCENT, mixing.MAX_EPOCHS, mixing.SEED
    domain = "'d' || coalesce(try_cast(substr(source, 4) AS INT) % 4, 0)"
    return f"""
WITH counted AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
  docs AS (SELECT * FROM counted WHERE tokens > 0),
  leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {epochs} AS held, ({DOMAIN_WEIGHT})::BIGINT AS dw,
    ({LANG_WEIGHT})::BIGINT AS lw, ({SOURCE_WEIGHT})::BIGINT AS weight FROM docs GROUP BY domain, lang, source),
  langs AS (SELECT domain, lang, sum(held)::BIGINT AS held, max(lw) AS weight, max(dw) AS dw FROM leaves GROUP BY domain, lang),
  asked AS (SELECT least(floor(sum(held) / {epochs} * {percent} / 100)::BIGINT, sum(held)::BIGINT) AS budget FROM langs),
  domains AS (SELECT 0 AS root, domain, sum(held)::BIGINT AS held, max(dw) AS weight, (SELECT budget FROM asked) AS budget FROM langs GROUP BY domain),
  {_allot_sql("domains", "root", "domain", "top")},
  langs2 AS (SELECT l.domain, l.lang, l.held, l.weight, t.share AS budget FROM langs l JOIN top t USING (domain)),
  {_allot_sql("langs2", "domain", "lang", "mid")},
  leaves2 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.held, l.weight, m.share AS budget FROM leaves l JOIN mid m ON l.domain = m.domain AND l.lang = m.lang),
  {_allot_sql("leaves2", "domain, lang", "source", "low")},
  plan AS (SELECT domain, lang, source, (share // tokens)::INT AS whole, share % tokens AS rest FROM low),
  planned AS (SELECT d.*, p.whole, p.rest FROM docs d JOIN plan p USING (domain, lang, source)),
  full_ AS (SELECT doc_id, domain, lang, source, unnest(range(0, whole))::INT AS epoch, tokens, tokens AS taken FROM planned),
  last_ AS (SELECT *, (sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, 'null')), tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto FROM planned WHERE rest > 0)
SELECT * FROM full_ UNION ALL
SELECT doc_id, domain, lang, source, whole AS epoch, tokens, least(tokens, rest - upto + tokens) AS taken FROM last_ WHERE upto - tokens < rest"""


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs that several pages carry."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.select(urls.canonical(F.col("url")).alias("canon")).groupBy("canon").count().filter("count > 1").select("canon")
    return urls.filter_urls(pages, listed)


SQL_OP6 = f"""
WITH parts AS (SELECT page_id, url, instr(url, '://') AS pos FROM pages),
  split AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM parts),
  named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
  canon AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS canon FROM named),
  rules(verdict, host, prefix) AS (VALUES {", ".join(map(str, urls.RULES))}),
  fits AS (SELECT c.page_id, c.host, c.path, arg_max(r.host || r.prefix, length(r.host || r.prefix)) AS rule, arg_max(r.verdict, length(r.host || r.prefix)) AS verdict
    FROM (SELECT DISTINCT page_id, host, path FROM canon) c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.prefix) GROUP BY ALL),
  listed AS (SELECT canon FROM canon WHERE canon IS NOT NULL GROUP BY canon HAVING count(*) > 1)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN fits f ON c.page_id = f.page_id AND c.host = f.host AND c.path = f.path LEFT JOIN listed l ON c.canon = l.canon"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(packing.TOKENIZER)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (F.coalesce(crc32_text(F.col("doc_id")), F.lit(1)) % 5 == 0).alias("held_out"), "score", "predicted")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.maximum_inner_product(table(spark, sf_dir, "embeddings"))


_FINITE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
SQL_OP7 = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, toxic_labels(spark, sf_dir)))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


SQL_OP11 = f"""
WITH w AS (SELECT row_number() OVER () AS key, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
  win AS (SELECT key, doc_id, i, array_to_string(ws[i + 1:i + {debruijn.K}], ' ') AS edge FROM (SELECT *, unnest(range(0, len(ws) - {debruijn.K - 1})) AS i FROM w)),
  least AS (SELECT edge, min(doc_id) AS src FROM win GROUP BY edge),
  gone AS (SELECT DISTINCT key, i + j AS at FROM (SELECT key, i FROM win JOIN least USING (edge) WHERE src < doc_id), range({debruijn.K}) t(j)),
  kept AS (SELECT u.key, string_agg(word, ' ' ORDER BY u.at) AS text FROM (SELECT key, unnest(ws) AS word, unnest(range(len(ws))) AS at FROM w) u LEFT JOIN gone g ON g.key = u.key AND g.at = u.at WHERE g.key IS NULL GROUP BY u.key)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (SELECT count(*) FROM gone g WHERE g.key = w.key)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k USING (key)"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.lower_cased_fifth())


#: Levels of a tree in the SQL: 16^8 nodes.
_DEPTH = 8


def _tree_sql(name: str, first: str) -> str:
    """Levels of the trees over ``first`` (tree, pos, digest), as SQL: name_0 to name_8 (tree, pos, digest, n)."""
    out = f"{name}_0 AS (SELECT tree, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM {first})"
    for k in range(_DEPTH):
        up = f"SELECT tree, pos // 16 AS pos, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {name}_{k} GROUP BY tree, pos // 16"
        out += f", {name}_{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({up}))"
    return out


def _fold_sql(name: str, rows: str, out: str) -> str:
    """``rows`` (key, tree, at, proof, value) folded through the trees ``name``."""
    sql, held = "", rows
    for k in range(_DEPTH):
        sql += f"""
  {out}_{k} AS (SELECT r.key, r.tree, r.at // 16 AS at, r.proof || CASE WHEN max(x.n) = 1 THEN '' ELSE coalesce(string_agg(x.digest, '' ORDER BY x.pos) FILTER (x.pos <> r.at), '') END AS proof,
    CASE WHEN max(x.n) = 1 THEN r.value ELSE sha256(string_agg(CASE WHEN x.pos = r.at THEN r.value ELSE x.digest END, '' ORDER BY x.pos)) END AS value
    FROM {held} r JOIN {name}_{k} x ON x.tree = r.tree AND x.pos // 16 = r.at // 16 GROUP BY r.key, r.tree, r.at, r.proof, r.value),"""
        held = f"{out}_{k}"
    return sql


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(part(text if f == "text" else f) for f in merkle.FIELDS) + ")"


SQL_OP12 = f"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tab FROM range(256) t(b)),
  marked AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 5 = 0 AS hit FROM documents, crc),
  leaves AS (SELECT row_number() OVER () AS key, doc_id, source, coalesce('s' || source, 'n') AS tree, {_leaf_sql("text")} AS leaf,
    CASE WHEN hit THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS value FROM marked),
  sorted AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
  first AS (SELECT tree, pos, leaf AS digest FROM sorted), {_tree_sql("sub", "first")},
  tops AS (SELECT '' AS tree, tree AS source_tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, digest FROM sub_{_DEPTH}), {_tree_sql("top", "tops")},
  asked AS (SELECT key, tree, pos AS at, '' AS proof, value FROM sorted),{_fold_sql("sub", "asked", "low")}
  mid AS (SELECT l.key, '' AS tree, t.pos AS at, l.proof, l.value FROM low_{_DEPTH - 1} l JOIN tops t ON l.tree = t.source_tree),{_fold_sql("top", "mid", "high")}
  root AS (SELECT digest AS root FROM top_{_DEPTH})
SELECT s.doc_id, s.leaf, t.digest AS subroot, root, sha256(h.proof) AS proof_sha256, h.value AS folded_root, h.value = root AS verified
FROM sorted s JOIN tops t ON s.tree = t.source_tree JOIN high_{_DEPTH - 1} h USING (key), root"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash, "op2_warc": op2_warc, "op3_mixing": op3_mixing, "op4_packing": op4_packing, "op5_quality": op5_quality,
        "op6_urls": op6_urls, "op7_top_k": op7_top_k, "op8_html": op8_html, "op9_neighbours": op9_neighbours, "op10_toxicity": op10_toxicity,
        "op11_passages": op11_passages, "op12_merkle": op12_merkle, "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": SQL_OP2, "op3_mixing": _sql_op3(), "op6_urls": SQL_OP6, "op7_top_k": SQL_OP7, "op11_passages": SQL_OP11, "op12_merkle": SQL_OP12}
