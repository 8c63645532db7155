"""Mixing sources to target weights by hierarchical budgeting.

Documents hang below a tree of domains, languages and sources. A token budget flows down
from the root by the nodes' weights. A node that can't use its share (its documents,
repeated up to a number of epochs, have too few tokens) leaves the rest to its siblings, and
only what all siblings can't use goes back to their parent's siblings. Each leaf then takes
a prefix of its documents, put in an order that a seed and the epoch decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import join_checked, materialize

#: Hexadecimal digits of the order key by which a leaf is cut into parts, so that no task sorts a whole leaf.
PART_DIGITS = 3
WORD_GAP = r"[\x20\x09-\x0D]+"
#: A domain for each source of the synthetic tables: sources are grouped by their last character.
DOMAIN = "concat('family', cast(ascii(right(source, 1)) % 3 as string))"
LANG_WEIGHTS = {"en": 4, "fr": 2, "de": 2, "es": 1}
DOMAIN_WEIGHTS = {"family0": 3, "family1": 2, "family2": 2}


def n_tokens(text: Column) -> Column:
    """Words of a text; null has none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")
    return F.size(words).cast("bigint")


def weight(node: Column, weights: dict[str, int]) -> Column:
    """The weight that ``weights`` gives a node, 1 by default."""
    out = F.lit(1)
    for name, value in weights.items():
        out = F.when(node == name, value).otherwise(out)
    return out.cast("double")


def share(nodes: DataFrame, parent: list[str], budget: Column, name: str) -> DataFrame:
    """Adds ``name``: each node's part of its parent's budget, never above its ``capacity``.

    Siblings are filled up at one level: ``weight * level``, or the capacity if that is less.
    With siblings in the order in which they fill up, the level is the largest of (budget left
    when those before are full) / (weights not yet full).
    """
    siblings = W.partitionBy(*parent)
    order = siblings.orderBy(F.col("capacity") / F.col("weight"), "node")
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = nodes.withColumn("__level", (budget - before) / open_weight)
    top = levels.withColumn("__top", F.greatest(F.max("__level").over(siblings), F.lit(0.0)))
    return top.withColumn(name, F.least("capacity", F.col("weight") * F.col("__top"))).drop("__level", "__top")


def _attach(nodes: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Parents' columns for each node; keys may be null."""
    parents = parents.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return nodes.join(parents, same).drop(*[f"__{k}" for k in keys])


def leaf_plan(slim: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """``(domain, lang, source, whole, rest)``: whole epochs of a leaf, and tokens of the one after them."""
    leaves = slim.groupBy("domain", "lang", "source").agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(F.floor(F.sum("tokens") * budget_share + 1e-6).alias("total"))
    nodes = domains.withColumn("root", F.lit(1)).withColumn("node", F.col("domain")).withColumn("weight", weight(F.col("domain"), weights.get("domain", {})))
    domains = share(nodes, ["root"], total.scalar(), "domain_budget").select("domain", "domain_budget")
    nodes = _attach(langs, domains, ["domain"]).withColumn("node", F.col("lang")).withColumn("weight", weight(F.col("lang"), weights.get("lang", {})))
    langs = share(nodes, ["domain"], F.col("domain_budget"), "lang_budget").select("domain", "lang", "lang_budget")
    nodes = _attach(leaves, langs, ["domain", "lang"]).withColumn("node", F.col("source")).withColumn("weight", weight(F.col("source"), weights.get("source", {})))
    leaves = share(nodes, ["domain", "lang"], F.col("lang_budget"), "budget").withColumn("budget", F.floor(F.col("budget") + 1e-6).cast("double"))
    whole = F.floor(F.col("budget") / F.col("tokens")).cast("int")
    return leaves.select("domain", "lang", "source", whole.alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest"))


def order_key(id_col: str, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _of_leaf(left: str, plan: DataFrame) -> Column:
    return F.col(f"{left}domain").eqNullSafe(plan["__p_domain"]) & F.col(f"{left}lang").eqNullSafe(plan["__p_lang"]) & F.col(f"{left}source").eqNullSafe(plan["__p_source"])


def mix(
    docs: DataFrame,
    budget_share: float,
    max_epochs: int = 1,
    seed: int = 7,
    weights: dict[str, dict[str, int]] | None = None,
    domain: str = DOMAIN,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with ``epoch`` (from 1), ``domain`` and ``n_tokens`` added.

    ``budget_share`` is the budget over all tokens of ``docs``. A leaf takes whole epochs, then
    documents in the order of an MD5 of seed, epoch and id until their tokens reach its budget;
    the last may go beyond it. Rows with equal ids in a leaf are taken together. Null domains,
    languages and sources are nodes of their own; texts without tokens are taken if the order
    puts them before the end of the prefix; leaves without tokens give nothing. Columns of the
    input named epoch, domain or n_tokens are replaced, names that begin with two underscores
    are reserved. Texts of any length are counted whole. An empty table gives an empty one.

    ``domain`` is an SQL expression over the columns (a column's name, or the host of a page's
    address). ``tokens`` is one that gives a document's tokens, such as the size of its BPE ids
    if they are there already; without it, words are counted (encoding every text for its count
    alone would cost several times the whole mixing). Documents with null tokens have none.

    Texts are never shuffled as long as the leaves are few (their size is checked): a first
    pass counts tokens, and all that the plan has for a leaf is one last key.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    counted = n_tokens(F.col(text_col)) if tokens is None else F.coalesce(F.expr(tokens).cast("bigint"), F.lit(0).cast("bigint"))
    slim = docs.select(F.col(id_col).alias("__id"), F.expr(domain).alias("domain"), F.col("lang"), F.col("source"), counted.alias("tokens"))
    slim = materialize(slim, "mix")
    leaves = leaf_plan(slim, budget_share, max_epochs, weights)
    plan = materialize(leaves.select(*[F.col(c).alias(f"__p_{c}") for c in ("domain", "lang", "source")], F.col("whole").alias("__whole"), F.col("rest").alias("__rest")), "mix-leaves")
    names = ["__p_domain", "__p_lang", "__p_source"]
    partial = join_checked(slim, plan.filter("__rest > 0"), _of_leaf("", plan), "inner")
    keyed = partial.withColumn("__key", order_key("__id", F.col("__whole") + 1, seed)).withColumn("__part", F.substring("__key", 1, PART_DIGITS))
    parts = keyed.groupBy(*names, "__rest", "__part").agg(F.sum("tokens").cast("double").alias("sum"))
    running = W.partitionBy(*names).orderBy("__part").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.sum("sum").over(running)).filter((F.col("upto") - F.col("sum") < F.col("__rest")) & (F.col("upto") >= F.col("__rest")))
    parts = materialize(parts.select(*[F.col(c).alias(f"c{c}") for c in names], F.col("__part").alias("c_part"), (F.col("upto") - F.col("sum")).alias("start")), "mix-parts")
    same = F.col("__part") == F.col("c_part")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"c{c}"))
    last = join_checked(keyed, parts, same, "inner").groupBy(*names, "__rest", "start", "__key").agg(F.sum("tokens").cast("double").alias("sum"))
    running = W.partitionBy(*names).orderBy("__key").rowsBetween(W.unboundedPreceding, 0)
    taken = last.withColumn("upto", F.col("start") + F.sum("sum").over(running)).filter(F.col("upto") - F.col("sum") < F.col("__rest"))
    cuts = taken.groupBy(*[F.col(c).alias(f"k{c}") for c in names]).agg(F.max("__key").alias("__last"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"k{c}"))
    final = materialize(plan.join(cuts, same, "left").drop(*[f"k{c}" for c in names]), "mix-cuts")
    rows = docs.withColumns({"domain": F.expr(domain), "n_tokens": counted})
    rows = join_checked(rows, final, _of_leaf("", final), "inner")
    more = F.coalesce((order_key(id_col, F.col("__whole") + 1, seed) <= F.col("__last")).cast("int"), F.lit(0))
    rows = rows.withColumn("__epochs", F.col("__whole") + more).filter("__epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__epochs"))))
    return rows.drop(*names, "__whole", "__rest", "__last", "__epochs")


def oracle(budget_share: float, max_epochs: int, seed: int = 7) -> str:
    """DuckDB SQL for ``mix`` over ``documents`` with the default tree and weights."""
    cases = lambda node, weights: f"CAST(CASE {' '.join(f"WHEN {node} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END AS DOUBLE)"

    def level(source: str, parent: str, node: str, budget: str, w: str) -> str:
        order = f"PARTITION BY {parent} ORDER BY capacity / {w}, {node}"
        return f"""SELECT *, least(capacity, {w} * greatest(max(lv) OVER (PARTITION BY {parent}), 0)) AS b FROM (
          SELECT *, ({budget} - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum({w}) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM {source})"""

    return f"""
WITH slim AS (SELECT doc_id, lang, source, 'family' || CAST(ascii(right(source, 1)) % 3 AS VARCHAR) AS domain,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS DOUBLE) AS capacity FROM slim GROUP BY ALL HAVING sum(n_tokens) > 0),
langs AS (SELECT domain, lang, sum(capacity) AS capacity FROM leaves GROUP BY ALL),
domains AS (SELECT domain, 1 AS root, sum(capacity) AS capacity FROM langs GROUP BY ALL),
d AS ({level("domains", "root", "domain", f"(SELECT floor(sum(tokens) * {budget_share} + 1e-6) FROM leaves)", cases("domain", DOMAIN_WEIGHTS))}),
l AS ({level("(SELECT langs.*, d.b AS up FROM langs JOIN d USING (domain))", "domain", "lang", "up", cases("lang", LANG_WEIGHTS))}),
s AS ({level("(SELECT leaves.*, l.b AS up FROM leaves JOIN l USING (domain, lang))", "domain, lang", "source", "up", "CAST(1 AS DOUBLE)")}),
plan AS (SELECT domain, lang, source, floor(floor(b + 1e-6) / tokens) AS whole, floor(b + 1e-6) - floor(floor(b + 1e-6) / tokens) * tokens AS rest FROM s),
keyed AS (SELECT slim.*, CAST(whole AS INTEGER) AS whole, rest, md5('{seed}:' || CAST(CAST(whole AS INTEGER) + 1 AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS k FROM slim JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(1, whole + 1 + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch FROM run
"""
