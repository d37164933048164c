"""Run a query on Spark and its SQL on DuckDB over the same tables and compare rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """A value as both engines can print it."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value) + 0.0:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return [plain(v) for v in value.values()]
    return str(value)


def rows_of_spark(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted(str([plain(r[n]) for n in names]) for r in (x.asDict(recursive=True) for x in df.collect()))


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())


def difference(df, con, sql: str) -> str:
    """Empty when both give the same rows."""
    a, b = rows_of_spark(df), rows_of_sql(con, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; {a[1][:2]} {b[1][:2]}"
    wrong = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(wrong)} of {len(a[1])} rows differ: {wrong[:2]}" if wrong else ""
