"""Run a query and its SQL counterpart and compare rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql, limit=3):
    """Empty when both sides hold the same columns and rows."""
    spark_rows = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    duck_rows = canonical(names, cur.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(spark_rows) != len(duck_rows):
        out.append(f"rows {len(spark_rows)} != {len(duck_rows)}")
    bad = [(a, b) for a, b in zip(spark_rows, duck_rows) if a != b or list(map(type, a)) != list(map(type, b))]
    if bad:
        out.append(f"{len(bad)} rows differ, e.g. {bad[:limit]}")
    return out, len(spark_rows)
