"""Spark against DuckDB, query by query."""

import math

import duckdb

from voxtab.fixtures import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    if isinstance(value, list):
        return [_cell(v) for v in value]
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_cell(row[k]) for k in order) for row in rows)


def mismatch(df, con, sql: str) -> str | None:
    """None where both give the same rows, else what differs."""
    result = con.execute(sql)
    duck_names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(duck_names):
        return f"columns {sorted(df.columns)} against {sorted(duck_names)}"
    ours = rows_of(df.columns, df.collect())
    theirs = rows_of(duck_names, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for mine, other in zip(ours, theirs, strict=True):
        if mine != other:
            return f"{mine} against {other}"
    return None
