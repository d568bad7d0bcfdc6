"""Compare a query with its SQL twin run by DuckDB in this process."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def _rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    types = {c[0]: str(c[1]) for c in rel.description}
    expected = _rows(names, rel.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    for name, dtype in spark_df.dtypes:
        if kinds.get(types[name], types[name]) != dtype:
            return f"type of {name}: {dtype} != {types[name]}"
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    diff = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(diff)} of {len(got)} rows differ, first: {str(diff[0])[:600]}" if diff else None
