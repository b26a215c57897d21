"""Compare a Spark result with its SQL counterpart, row by row."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """Views of the tables; a folder holds the part files of its table."""
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        files = path if path.is_file() else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (decimal.Decimal, float)):
        return round(float(value), 9)
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    oracle_names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(oracle_names):
        return [f"columns {sorted(set(df.columns) ^ set(oracle_names))}"]
    expected = _rows(oracle_names, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        return [f"rows {len(actual)} != {len(expected)}"]
    out = []
    names = sorted(oracle_names)
    for a, e in zip(actual, expected):
        if a != e:
            out.append(str({n: (x, y) for n, x, y in zip(names, a, e) if x != y}))
    return out
