"""Mixing sources to target weights by hierarchical budgeting, in SQL functions only.

Leaves are (domain, lang, source).  A token budget runs down the tree: at each
node it is split among the children in proportion to their weights, but no
child gets more than its subtree holds (its tokens times ``max_epochs``).  What
a child cannot take is shared by its siblings before it is left to the nodes
above, since a node asks its parent only for what its whole subtree can hold.
All shares are whole tokens and add up exactly.

A leaf then takes whole epochs while its budget lasts and a prefix of one more,
each in an order of its own that the seed fixes.  The order is cut into equal
ranges of the order key, and the range in which the budget ends is cut again, so
only about one row in 16 million of a leaf has to be sorted; a hot leaf is never
gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, written

LEVELS = ("domain", "lang", "source")
SEED = 17
#: How often a document may be taken.
MAX_EPOCHS = 4
#: Part of all tokens that is asked for, in hundredths.
BUDGET_PERCENT = 60
#: Hex digits of the order key by which a leaf is cut into ranges, and by which its last range is cut again.
RANGE_DIGITS = (3, 6)


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def allot(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Water filling: adds ``share`` to ``nodes`` (parent columns, child, weight, held, budget).

    ``budget`` is the parent's and at most the sum of ``held``.  Children are
    filled in the order of held / weight while their proportional share of what
    is left covers all they hold; the others split the rest by weight.
    """
    by = Window.partitionBy(*parent).orderBy((F.col("held") / F.col("weight")).asc(), child)
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    upto, group = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*parent)
    step = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(onward))
    step = step.withColumn("full", F.col("held").cast("decimal(19,0)") * F.col("weights") <= F.col("left").cast("decimal(19,0)") * F.col("weight"))
    step = step.withColumn("rest", F.max(F.when(~F.col("full"), F.col("left"))).over(group)).withColumn("over", F.max(F.when(~F.col("full"), F.col("weights"))).over(group))
    step = step.withColumn("reach", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(upto))
    part = F.expr("cast((cast(rest as decimal(19,0)) * reach) div over - (cast(rest as decimal(19,0)) * (reach - weight)) div over as bigint)")
    return step.withColumn("share", F.when(F.col("full"), F.col("held")).otherwise(part)).drop("left", "weights", "full", "rest", "over", "reach")


def leaf_budgets(leaves: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """domain, lang, source, tokens, budget for ``leaves`` (.., tokens, domain_weight, lang_weight, source_weight)."""
    held = leaves.filter("tokens > 0").withColumn("held", F.col("tokens") * max_epochs)
    langs = held.groupBy("domain", "lang").agg(F.sum("held").alias("held"), F.max("lang_weight").alias("weight"), F.max("domain_weight").alias("domain_weight"))
    domains = langs.groupBy("domain").agg(F.sum("held").alias("held"), F.max("domain_weight").alias("weight"))
    whole = domains.agg((F.sum("held") / max_epochs * budget_percent / 100).cast("long").alias("asked"), F.sum("held").alias("all_held"))
    root = whole.select(F.lit(0).alias("root"), F.least("asked", "all_held").alias("budget"))
    top = allot(domains.withColumn("root", F.lit(0)).join(root, "root"), ["root"], "domain").select("domain", F.col("share").alias("budget"))
    mid = allot(langs.drop("domain_weight").join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    low = held.select(*LEVELS, "tokens", "held", F.col("source_weight").alias("weight")).join(mid, ["domain", "lang"])
    return allot(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", F.col("share").alias("budget"))


def mix(docs: DataFrame, weights: dict[str, Column], budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, epoch, tokens, taken, and the ``carried`` columns: what each leaf takes.

    ``docs`` has doc_id, text, domain, lang, source; ``weights`` has the columns
    ``domain``, ``lang`` and ``source`` of positive whole weights, made of those.
    ``taken`` is less than ``tokens`` only in the row with which a leaf's budget
    ends.  Null levels count as ``''``; documents without words are never taken;
    rows that repeat an id, or have none, are separate documents of one place in
    the order (of them, those with fewer tokens come first).  Other columns play
    no part; an empty table gives an empty result.
    """
    level = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS]
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *level, token_count(F.col("text").cast("string")).alias("tokens"), *carried).filter("tokens > 0")
    counted = written(counted, "mixing-counts")
    leaves = counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")).select("*", *(w.cast("long").alias(f"{k}_weight") for k, w in weights.items()))
    plan = leaf_budgets(leaves, budget_percent, max_epochs)
    plan = written(plan.select(*LEVELS, F.expr("budget div tokens").cast("int").alias("whole"), F.expr("budget % tokens").alias("rest")), "mixing-plan")
    planned = counted.join(plan, list(LEVELS))
    columns = ["doc_id", *LEVELS, F.col("whole").alias("epoch"), "tokens"]
    taken = planned.filter("whole > 0").select("doc_id", *LEVELS, F.explode(F.expr("sequence(0, whole - 1)")).alias("epoch"), "tokens", F.col("tokens").alias("taken"), *carried)
    edge = planned.filter("rest > 0").withColumn("key", order_key(F.col("doc_id"), F.col("whole"), seed)).withColumn("before", F.lit(0).cast("long"))
    for digits in RANGE_DIGITS:
        edge = edge.withColumn("range", F.substring("key", 1, digits))
        sums = edge.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("range_tokens"), F.max("before").alias("base"))
        start = F.col("base") + F.sum("range_tokens").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("range_tokens")
        edge = edge.drop("before").join(sums.select(*LEVELS, "range", start.alias("before"), "range_tokens"), [*LEVELS, "range"]).filter("before < rest")
        taken = taken.unionByName(edge.filter("before + range_tokens <= rest").select(*columns, F.col("tokens").alias("taken"), *carried))
        edge = edge.filter("before + range_tokens > rest").drop("range_tokens")
    order = Window.partitionBy(*LEVELS, "range").orderBy("key", "tokens", *carried).rowsBetween(Window.unboundedPreceding, 0)
    cut = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(order)).filter("upto - tokens < rest")
    return taken.unionByName(cut.select(*columns, F.least(F.col("tokens"), F.col("rest") - F.col("upto") + F.col("tokens")).alias("taken"), *carried))


def mixed_texts(docs: DataFrame, domain: Column, weights: dict[str, Column], budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source and any others) that ``mix`` takes, once for each epoch, with their columns.

    A document of which a leaf takes only a prefix keeps its first ``taken``
    words, joined by single spaces; ``n_chars`` follows the text.  Rows get a
    number of their own, so null and repeated ids meet only their own row;
    columns of ``docs`` may have any names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    numbered = written(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("number")), "mixing-rows")
    narrow = numbered.select("row.doc_id", "row.text", "row.lang", "row.source", "number").withColumn("domain", domain)
    taken = mix(narrow, weights, budget_percent, max_epochs, seed, ("number",))
    part = taken.select("number", F.when(F.col("taken") < F.col("tokens"), F.col("taken")).alias("words"))
    rows = numbered.join(part, "number")
    text = F.col("row.text")
    prefix = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")))
    rows = rows.withColumn("cut", F.when(F.col("words").isNotNull(), prefix))
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    out["text"] = F.coalesce("cut", text)
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("cut").isNull(), out["n_chars"]).otherwise(F.length("cut")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(v.alias(c) for c, v in out.items()))
