"""Side-by-side comparison of a registered query and its SQL oracle."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: tuple(map(repr, r)))


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns, row count, value types and values agree."""
    got_cols, got = _sorted(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = _sorted(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"got {str(a)[:600]} want {str(b)[:600]} ({got_cols})"
    return None
