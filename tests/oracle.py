"""Rows of a query and of its SQL, made comparable."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def database(root):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for n in os.listdir(root):
        c.sql(f"CREATE VIEW {n.split('.')[0]} AS SELECT * FROM '{root}/{n}'")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(c, sql):
    rel = c.sql(sql)
    at = {n: i for i, n in enumerate(rel.columns)}
    cols = sorted(at)
    return cols, sorted(repr(tuple(plain(r[at[n]]) for n in cols)) for r in rel.fetchall())
