"""Manifest diff, stat fast path, carry-forward merge, snapshot deletes and staleness, all as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Full outer join of (path, sha256): new, changed, unchanged or removed. A null hash differs from any other."""
    c, s = current.select("path", F.col("sha256").alias("h_new"), F.lit(1).alias("c")), stored.select("path", F.col("sha256").alias("h_old"), F.lit(1).alias("s"))
    status = F.when(F.col("s").isNull(), "new").when(F.col("c").isNull(), "removed").when(F.col("h_new").eqNullSafe(F.col("h_old")), "unchanged").otherwise("changed")
    return c.join(s, "path", "full_outer").select("path", "h_new", "h_old", status.alias("status"))


def to_process(d: DataFrame) -> DataFrame:
    return d.where(F.col("status").isin("new", "changed")).select("path")


def to_delete(d: DataFrame) -> DataFrame:
    return d.where(F.col("status").isin("removed", "changed")).select("path")


def stat_partition(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Each current path is ``unchanged`` if size and mtime are known on both sides and equal, else ``changed``."""
    s = stored.select("path", F.col("size").alias("size0"), F.col("mtime_ms").alias("mtime0"), F.col("sha256").alias("sha0"), "token_count")
    same = (F.col("size") == F.col("size0")) & (F.col("mtime_ms") == F.col("mtime0"))
    return current.join(s, "path", "left").withColumn("stat", F.when(same, "unchanged").otherwise("changed"))


def needs_read(verify: bool = False) -> Column:
    """On the rows of :func:`stat_partition`: read if forced, changed, or without a stored hash or token count."""
    return F.lit(verify) | (F.col("stat") == "changed") | F.col("sha0").isNull() | F.col("token_count").isNull()


def carry_forward(paths: DataFrame, stored: DataFrame, fresh: DataFrame, value: str) -> DataFrame:
    """Fresh value, else the stored one, for every current path."""
    return paths.join(fresh.select("path", F.col(value).alias("f")), "path", "left").join(stored.select("path", F.col(value).alias("o")), "path", "left").select("path", F.coalesce("f", "o").alias(value))


def delete_paths(rows: DataFrame, paths: DataFrame, col: str) -> DataFrame:
    """``rows`` without those whose ``col`` is among ``paths(path)``; a null ``col`` stays."""
    return rows.join(paths.select(F.col("path").alias(col)).distinct(), col, "left_anti").select(*rows.columns)


def staleness(stats: DataFrame, indexed_at_ms: float) -> DataFrame:
    """One row: files newer than the index, and the newest of them (ties: smallest path)."""
    newer = stats.where(F.col("mtime_ms") > indexed_at_ms)
    first = F.min(F.struct((-F.col("mtime_ms")).alias("m"), "path"))
    return newer.agg(F.count("*").alias("n_newer"), first.alias("x")).select("n_newer", F.col("x.path").alias("newest_path"), (-F.col("x.m")).alias("newest_mtime"))
