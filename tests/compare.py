"""A query's rows against those of its SQL in DuckDB, as multisets."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEXTMILL_TEST_DATA", "/root/testdata/sf0.001")


def connect(d: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, bytearray):
        return bytes(x)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in got.fetchall())


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect())


def differ(df, con, sql: str) -> str:
    (a, x), (b, y) = rows_of(df), rows_of_sql(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    more, less = x - y, y - x
    return "" if not more and not less else f"{sum(more.values())} rows only here, {sum(less.values())} only in SQL of {sum(y.values())}: {str(list(more)[:1])[:300]} and {str(list(less)[:1])[:300]}"
