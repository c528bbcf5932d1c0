"""Rows of a query against rows of its SQL, as the driver compares them."""

import datetime
import glob
import math
import os
from collections import Counter

import duckdb


def connection(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.7g}") if abs(v) < 1e15 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def difference(df, sql, con):
    """(only in Spark, only in SQL), a few of each."""
    columns = sorted(df.columns)
    told = con.execute(sql)
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    a = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    b = Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in told.fetchall())
    return list((a - b).items())[:3], list((b - a).items())[:3]
