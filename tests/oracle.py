"""Compares a query with its DuckDB equivalent, whatever the order of rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(canonical(r[k]) for k in order) for r in rows)


def assert_equal(df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, found.fetchall())
    assert got == want
    return len(got)
