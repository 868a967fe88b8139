"""A query's rows against its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (int, float)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, con, sql):
    """Raise AssertionError unless both have the same columns and rows."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), f"{len(got[1])} rows, SQL has {len(want[1])}; {got[1][:2]} {want[1][:2]}"
    for a, b in zip(got[1], want[1]):
        assert a == b, (a, b)
    return len(got[1])
