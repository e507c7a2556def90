"""Compare a query with DuckDB on the same tables, as values and by column name."""

import os

import duckdb
import numpy as np


def plain(x):
    if x is None or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (float, np.floating)):
        return round(float(x), 6)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x.item() if isinstance(x, np.generic) else x


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def same(df, sql, con):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    r = con.execute(sql)
    have = [x[0] for x in r.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert got == want
