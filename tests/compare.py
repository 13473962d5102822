"""Run a query and its SQL side by side and compare rows in any order."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 6)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, sf_dir, query, sql):
    start = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return "rows-only", len(rows), took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(rows), took
    got, want = canonical(df.columns, rows), canonical(names, expected)
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"differs: {len(got)} vs {len(want)}; spark-only {extra}; sql-only {missing}", len(rows), took
    return "match", len(rows), took
