"""Quality rules whose failures are also judged by host.

Each document is held against rules on its own text. The failures are counted by host,
each host's failure rate is shrunk towards the mean by a beta prior fitted to all hosts,
and a host takes its remaining documents with it if its documents fail credibly more often
than the corpus: the lower bound of its shrunk rate has more than ODDS times the odds of the
mean. The limit is relative, so it needs no knowledge of how strict the rules are, and where
hosts differ by chance only, no host falls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import join_checked, materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
#: A host is rejected if its odds of failure, two deviations below its shrunk rate, are twice those
#: of the corpus: it then fails twice as often beyond doubt, whatever the rules' own strictness.
ODDS, DEVIATIONS = 2.0, 2.0
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WEIGHTS = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words that is found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    codes = codes ^ (codes >> np.uint64(29))
    windows = codes[:n] * _WEIGHTS[0]
    for k in range(1, WINDOW):
        windows = windows + codes[k : k + n] * _WEIGHTS[k]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int32)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_metrics(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return (0, 0, 0, 0, 0)
    words = text.encode("utf-8", "replace").split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in METRICS]))
def _metrics(texts: pa.Array) -> pa.Array:
    rows = np.array([text_metrics(text.as_py()) for text in texts], dtype=np.int64).reshape(-1, len(METRICS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(METRICS))], names=list(METRICS))


def base_failed(q: Column, min_words: int = 20, max_repeat_percent: int = 30) -> Column:
    return (q["n_words"] < min_words) | (100 * q["n_repeat_words"] > max_repeat_percent * q["n_words"])


def host_verdicts(rated: DataFrame, odds: float = ODDS, deviations: float = DEVIATIONS) -> DataFrame:
    """``(host, host_rate, host_kept)`` from rows ``(host, failed)``.

    The prior's mean is the overall rate. Its weight is 1 / rho - 1, where rho is the share of
    the rates' variance that lies between hosts: the moment estimate of a beta-binomial, so the
    noise of small hosts isn't taken for a difference. ``host_rate`` is the posterior's mean; a
    host is rejected if that less ``deviations`` standard deviations of the posterior has more
    than ``odds`` times the odds of the prior's mean. A null host is a host of its own; a single
    host is never rejected.
    """
    hosts = rated.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("bigint")).alias("bad"))
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    total = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum(n).alias("all_n"), F.sum(bad).alias("all_bad"), F.sum(bad * bad / n).alias("bad2"), F.sum(n * n).alias("n2"))
    mean = F.col("all_bad") / F.col("all_n")
    noise = mean * (1 - mean)
    spread = F.try_divide(F.col("bad2") - F.col("all_n") * mean * mean, noise) - (F.col("h") - 1)
    rho = F.try_divide(spread, F.col("all_n") - F.col("n2") / F.col("all_n") - (F.col("h") - 1))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1e-6)), F.lit(0.5))
    prior = total.select(F.struct(mean.alias("mean"), (1 / rho - 1).alias("n"))).scalar()
    rate = (bad + prior["mean"] * prior["n"]) / (n + prior["n"])
    low = rate - deviations * F.sqrt(rate * (1 - rate) / (n + prior["n"] + 1))
    rejected = low * (1 - prior["mean"]) > odds * prior["mean"] * (1 - low)
    return hosts.select("host", rate.alias("host_rate"), (~rejected).alias("host_kept"))


def _judged(rated: DataFrame, odds: float) -> DataFrame:
    """Adds ``host_rate`` and ``host_kept``; Spark broadcasts the hosts only if they turn out small."""
    verdicts = host_verdicts(rated.select(F.col("__host").alias("host"), F.col("__failed").alias("failed")), odds)
    return rated.join(verdicts, rated["__host"].eqNullSafe(verdicts["host"])).drop("host")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", odds: float = ODDS) -> DataFrame:
    """One row for each row of ``docs``: id, metrics, ``base_failed``, ``host_rate``, ``kept``.

    A null or empty text has no words and fails; null hosts are judged together; null
    ids and repeated rows each get their row; an empty table gives an empty one. Other
    columns are not read, so they can't clash. Texts may be of any length: one is held at a time,
    with a few numbers for each of its words. The text is read once: its metrics are
    written to the shared folder before hosts are counted.
    """
    rated = docs.select(F.col(id_col).alias("__id"), F.col(host_col).cast("string").alias("__host"), _metrics(F.col(text_col)).alias("__q"))
    rated = materialize(rated.withColumn("__failed", base_failed(F.col("__q"))), "quality")
    return _judged(rated, odds).select(
        F.col("__id").alias(id_col), *[F.col(f"__q.{m}").alias(m) for m in METRICS], F.col("__failed").alias("base_failed"), "host_rate", (~F.col("__failed") & F.col("host_kept")).alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", odds: float = ODDS) -> DataFrame:
    """The rows of ``docs``, all columns, that pass their own rules and those of their host.

    The texts are shuffled only if the hosts' verdicts turn out too large to broadcast.
    Edge cases are those of ``quality_verdicts``.
    """
    rated = docs.withColumn("__failed", base_failed(_metrics(F.col(text_col)))).withColumn("__host", F.col(host_col).cast("string"))
    rated = materialize(rated, "quality")
    verdicts = host_verdicts(rated.select(F.col("__host").alias("host"), F.col("__failed").alias("failed")), odds)
    verdicts = materialize(verdicts.filter("host_kept").select(F.col("host").alias("__good_host")), "hosts")
    return join_checked(rated.filter("not __failed"), verdicts, F.col("__host").eqNullSafe(F.col("__good_host")), "left_semi").select(*docs.columns)


#: DuckDB SQL for ``quality_verdicts`` over ``documents``, with ODDS and DEVIATIONS of 2.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM windows JOIN twice USING (doc_id, win)),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS bad FROM f GROUP BY source),
total AS (SELECT count(*) AS h, sum(n) AS all_n, sum(bad) / sum(n) AS mean, sum(bad * bad / n) AS bad2, sum(n * n) AS n2 FROM hosts),
spread AS (SELECT *, ((bad2 - all_n * mean * mean) / nullif(mean * (1 - mean), 0) - (h - 1)) / nullif(all_n - n2 / all_n - (h - 1), 0) AS rho FROM total),
prior AS (SELECT mean, 1 / least(greatest(coalesce(rho, 0), 1e-6), 0.5) - 1 AS k FROM spread),
shrunk AS (SELECT source, mean, k, n, (bad + mean * k) / (n + k) AS rate FROM hosts, prior),
judged AS (SELECT source, rate, mean, rate - 2.0 * sqrt(rate * (1 - rate) / (n + k + 1)) AS low FROM shrunk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
  NOT base_failed AND NOT low * (1 - mean) > 2.0 * mean * (1 - low) AS kept
FROM f JOIN judged j ON f.source IS NOT DISTINCT FROM j.source
"""
