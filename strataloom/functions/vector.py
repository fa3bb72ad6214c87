"""Cosine measures on array columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, to 12 decimals; null for null, empty, all-zero vectors or unequal lengths."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.round(F.lit(1.0) - dot(a, b) / n, 12) + F.lit(0.0))


def non_zero(v: Column) -> Column:
    """Null passes; an empty or all-zero vector doesn't."""
    return v.isNull() | F.exists(v, lambda x: x != 0)
