"""Comparison of a query with its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, [tuple(r) for r in df.select(*columns).collect()]


def rows_of_sql(db, sql: str) -> tuple[list[str], list[tuple]]:
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in result.fetchall()]


def _key(row: tuple) -> tuple:
    return tuple(
        ("", "") if v is None else (type(v).__name__ if not isinstance(v, (int, float, bool)) else "n",
                                     f"{v:.9g}" if isinstance(v, float) else str(v))
        for v in row
    )


def difference(got: tuple, want: tuple) -> str | None:
    """First difference between two (columns, rows) pairs, exact to the last bit; None if equal."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])} rows"
    for a, b in zip(sorted(got[1], key=_key), sorted(want[1], key=_key)):
        for x, y in zip(a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            if not same:
                return f"{got[0]}\n  {a}\n  {b}"
            if x is not None and type(x) is not type(y):
                return f"type {type(x)} != {type(y)} in {a} / {b}"
    return None
