"""Holds registered queries against their SQL in DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb

#: The smallest tables.
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in data))


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same columns and rows."""
    df = query(spark, sf_dir)
    got, names = [tuple(r) for r in df.collect()], df.columns
    result = con.execute(sql)
    want_names = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(want_names):
        return f"columns {sorted(names)} and {sorted(want_names)}"
    a, b = rows(names, got), rows(want_names, want)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"{len(a)} and {len(b)} rows; {odd}"
    return ""
