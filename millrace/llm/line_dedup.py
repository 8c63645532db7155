"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host, the pages that contain a line are divided by all of the host's pages. A
line above the ratio is boilerplate of that host and is dropped from its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_checked, materialize

#: A line is boilerplate if more than this share of its host's pages contain it, three at least.
MAX_RATIO, MIN_PAGES = 0.02, 3


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, by_text: bool = False) -> DataFrame:
    """``(__host, __drop array<bigint>)``: for each host the hashes of its boilerplate lines.

    Lines are counted once a page, by host and hash, so that a host with many pages is
    spread over all tasks. A host's array can't exceed its mean distinct lines a page
    divided by ``max_ratio``, however many pages it has.

    With ``by_text``, pages of a host with equal texts count as one page, in both numbers of
    the ratio, so that the lines of a text aren't boilerplate because of its copies. Texts
    are compared by 96 bits of hashes; only those and the hashes of lines are shuffled.
    """
    found = F.array_distinct(F.transform(F.filter(lines(F.col(text_col)), lambda line: ~_blank(line)), lambda line: F.xxhash64(line)))
    keyed = pages.select(F.col(host_col).alias("__host"), found.alias("__lines"), *([F.xxhash64(text_col).alias("__a"), F.hash(text_col).alias("__b")] if by_text else []))
    if by_text:
        keyed = materialize(keyed.groupBy("__host", "__a", "__b").agg(F.first("__lines").alias("__lines")), "texts")
    totals = keyed.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    counts = keyed.select("__host", F.explode("__lines").alias("__line")).groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_pages)
    frequent = counts.join(totals, counts["__host"].eqNullSafe(totals["__host"])).filter(F.col("__n") > max_ratio * F.col("__pages"))
    return frequent.groupBy(counts["__host"]).agg(F.array_sort(F.collect_list("__line")).alias("__drop"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, by_text: bool = False) -> DataFrame:
    """Adds ``kept_text``, ``n_lines`` and ``n_dropped`` to each row of ``pages``.

    Blank lines always stay. A null text stays null with no lines; an empty text is one
    blank line; null hosts count as one host; repeated rows count as pages of their own
    unless ``by_text`` is set (see ``boilerplate``); an empty table gives an empty one. Columns of those three names in the input are replaced;
    names that begin with two underscores are reserved. The pages are not shuffled as long
    as the hosts' arrays are small (their size is checked); otherwise they are joined by a
    shuffle, in which Spark splits large hosts.
    """
    drops = materialize(boilerplate(pages, host_col, text_col, max_ratio, min_pages, by_text), "boilerplate")
    drops = drops.withColumnRenamed("__host", "__of")
    joined = join_checked(pages, drops, F.col(host_col).eqNullSafe(F.col("__of")), "left")
    all_lines = lines(F.col(text_col))
    kept = F.when(F.col("__drop").isNull(), all_lines).otherwise(F.filter(all_lines, lambda line: _blank(line) | ~F.array_contains(F.col("__drop"), F.xxhash64(line))))
    out = joined.withColumn("__kept", kept).withColumns({
        "kept_text": F.array_join("__kept", "\n"),
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines)).cast("bigint"),
        "n_dropped": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines) - F.size("__kept")).cast("bigint"),
    })
    return out.drop("__of", "__drop", "__kept")


ORACLE = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
found AS (SELECT DISTINCT doc_id, source, unnest(ls) AS line FROM pages),
frequent AS (
  SELECT f.source, f.line FROM found f JOIN totals t ON f.source IS NOT DISTINCT FROM t.source
  WHERE trim(f.line) <> '' GROUP BY f.source, f.line, t.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*) > CAST({MAX_RATIO} AS DOUBLE) * t.pages),
drops AS (SELECT source, list(line) AS lines FROM frequent GROUP BY source),
kept AS (
  SELECT p.doc_id, p.ls, CASE WHEN d.lines IS NULL THEN p.ls ELSE list_filter(p.ls, lambda x: NOT list_contains(d.lines, x)) END AS ks
  FROM pages p LEFT JOIN drops d ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(ks), 0) AS BIGINT) AS n_dropped,
  sha256(array_to_string(ks, chr(10))) AS kept_sha256
FROM kept
"""
