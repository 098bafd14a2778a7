"""Run a registered query and its check SQL side by side."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

from catalog.fixtures import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=repr)


def spark_rows(df):
    return df.columns, df.collect()


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    names, rows = spark_rows(df)
    cur = con.execute(sql)
    other = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(other):
        return [f"columns {sorted(names)} against {sorted(other)}"]
    got, want = _rows(names, rows), _rows(other, expected)
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}"]
    if not got:
        return ["no rows on either side"]
    return [f"{g} against {w}" for g, w in zip(got, want) if g != w][:limit]
