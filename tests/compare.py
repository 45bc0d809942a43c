"""The driver's comparison: a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import numpy as np


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return float(v) if isinstance(v, decimal.Decimal) else v


def rows(columns, found):
    return sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr)


def assert_equal(df, sf_dir: str, sql: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = rows(columns, [dict(zip(names, r)) for r in got.fetchall()])
    assert rows(columns, df.collect()) == want
