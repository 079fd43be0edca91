"""Compares registered queries with their SQL in DuckDB, as the driver does."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, query, sql, sf_dir, tolerance=2e-6):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    if got == want:
        return None
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance for x, y in zip(a, b))]
    near = sum(a != b for a, b in zip(got, want)) - len(bad)
    return f"{len(bad)} rows differ, {near} by rounding: {bad[:2]}"
