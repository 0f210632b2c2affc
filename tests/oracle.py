"""Compares a query with its SQL, run by DuckDB over the same tables."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            p = p if os.path.isfile(p) else f"{p}/*.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, Decimal):
        return int(x) if x == int(x) else float(x)
    return x


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf_dir: str) -> int:
    cur = connect(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want, rows = bag(names, cur.fetchall()), df.collect()
    assert sorted(names) == sorted(df.columns)
    got = bag(df.columns, rows)
    assert got == want, f"{sum(got.values())} rows against {sum(want.values())}; differing: {list((got - want).items())[:3]} {list((want - got).items())[:3]}"
    return len(rows)
