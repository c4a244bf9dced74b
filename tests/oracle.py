"""Runs a query's SQL in DuckDB and compares rows with Spark's, floats to six places."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "item"):
        return _plain(x.item())
    if type(x).__name__ == "Decimal":
        return _plain(float(x))
    if isinstance(x, bool):
        return int(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql):
    """None, or what differs."""
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(got, want):
        if a == b:
            continue
        if len(a) == len(b) and all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 + 1e-9 * abs(y)) for x, y in zip(a, b)):
            continue
        return f"{a} and {b}"
    return None
