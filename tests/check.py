"""Comparing a query's rows with its SQL's, regardless of order."""

import math

import numpy as np


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([normal(x) for x in v])
    return str(v)


def assert_same(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    at = [relation.columns.index(c) for c in cols]
    got = sorted(tuple(normal(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(normal(r[i]) for i in at) for r in relation.fetchall())
    assert got == want
