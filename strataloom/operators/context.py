"""Context within a token budget, its accounting, and the file-reading baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import ranking as R
from strataloom.functions import text as X

# Tokens that one tool call costs, files a reader would open, largest shown percentage.
CALL_TOKENS, READ_FILES, MAX_PCT = 300, 5, 98
SALTS = 32


def budget_fill(rows: DataFrame, budget: int, separator: int, by: list[str], *order: str) -> DataFrame:
    """Rows (with ``tokens``) of each group up to the first that doesn't fit; the separator costs for every row but the first.

    Costs are never negative, so the running sum decides. Null tokens cost 0. With a separator at most budget // separator + 1
    rows can fit; each salted part of a group is cut to so many first, so a group of any size leaves one task few rows.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    if separator > 0:
        part = Window.partitionBy(*by, F.pmod(F.xxhash64(*order), F.lit(SALTS))).orderBy(*order)
        rows = rows.withColumn("__n", F.row_number().over(part)).where(F.col("__n") <= budget // separator + 1).drop("__n")
    cost = F.sum(F.coalesce("tokens", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(separator) * (F.row_number().over(w) - 1)
    return rows.withColumn("used", cost).where(F.col("used") <= budget)


def reading_baseline(chunks: DataFrame, manifest: DataFrame, query: str, how: str) -> DataFrame:
    """Tokens a reader would spend without an index: the five files of best total (``sum``) or best single (``max``) boost, plus calls.

    One row (base_tokens, n_files). No file: one call. Files without a count cost 0; of several manifest rows the largest counts.
    """
    tokens = X.query_tokens(F.lit(query))
    boost = R.keyword_boost(tokens, F.col("file_path"), F.col("name"))
    agg = F.sum("boost") if how == "sum" else F.max("boost")
    files = chunks.withColumn("boost", boost).where(F.col("boost") > 0).groupBy("file_path").agg(F.round(agg, 9).alias("b")).orderBy(F.desc("b"), "file_path").limit(READ_FILES)
    m = manifest.groupBy(F.col("path").alias("file_path")).agg(F.max("token_count").alias("t"))
    got = files.join(m, "file_path", "left")
    return got.agg((F.coalesce(F.sum(F.coalesce("t", F.lit(0))), F.lit(0)) + (1 + F.count("*")) * CALL_TOKENS).cast("bigint").alias("base_tokens"), F.count("*").alias("n_files"))


def raw_reduction(sent: Column, base: Column) -> Column:
    return F.when(base > 0, X.js_round((1 - sent / base) * 100)).otherwise(0).cast("int")


def reduction(sent: Column, base: Column) -> Column:
    """Shown percentage, in 0..98."""
    return F.least(F.greatest(raw_reduction(sent, base), F.lit(0)), F.lit(MAX_PCT)).cast("int")


def savings_mode(sent: Column, base: Column) -> Column:
    return F.when(raw_reduction(sent, base) >= 99, "filtering_only").otherwise("full")
