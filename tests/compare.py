"""Run a query in Spark and its SQL in DuckDB and report the first difference."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
TABLES += ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(folder: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return float(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(shaped, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def difference(df, sql: str, db, tolerance: float = 0.0) -> str | None:
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(sql)
    want_columns, want = _rows([c[0] for c in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        for c, a, b in zip(got_columns, g, w):
            same = a == b and isinstance(a, str) == isinstance(b, str)
            if not same and tolerance and isinstance(a, (int, float)) and isinstance(b, (int, float)):
                same = abs(a - b) <= tolerance * max(1.0, abs(b))
            if not same:
                return f"{c}: {a!r} != {b!r} in {g} / {w}"
    return None
