"""Comparing results as multisets of rows."""

import datetime
import decimal
import math
from collections import Counter


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def bag(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


def same_as_oracle(df, duck, sql):
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = bag(df.columns, [tuple(r) for r in df.collect()]), bag(rel.columns, rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def nodes(df):
    """Physical plan text before adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString()
