"""Compares a query's rows with those of its SQL, run by DuckDB on the same files."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return float(f"{x:.10g}")
    return str(x)


def rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(t[i]) for i in order) for t in tuples)


def compare(df, sql, root):
    c = duckdb.connect()
    for f in Path(root).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want, have = rows(names, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
