"""Compare registered queries with their SQL on the same Parquet tables."""

from __future__ import annotations

import math
import time

import duckdb

from vectab.checks.common import TABLES


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v + 0.0, 9)
    try:
        return round(float(v), 9)
    except (TypeError, ValueError):
        return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_value(r[i]) for i in order] for r in rows), key=repr)


def check(spark, con, sf, name, query, sql) -> tuple[bool, str]:
    start = time.time()
    frame = query(spark, sf)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - start
    if sql is None:
        return len(got) > 0, f"{name}: {len(got)} rows, no SQL, {spent:.1f}s"
    start = time.time()
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = _rows(names, con.fetchall())
    note = f"{name}: {len(got)} rows, {spent:.1f}s (SQL {time.time() - start:.1f}s)"
    if sorted(names) != sorted(frame.columns):
        return False, f"{note}: columns {sorted(frame.columns)} against {sorted(names)}"
    if got != want:
        first = next(((a, b) for a, b in zip(got, want) if a != b), (len(got), len(want)))
        return False, f"{note}: differs ({len(got)} against {len(want)} rows), first {str(first)[:400]}"
    return True, note
