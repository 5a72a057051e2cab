"""Compare registered queries with their SQL in DuckDB, one line per query."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9)
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None where both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} <> {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(want_cols)}: {str(x)[:300]} <> {str(y)[:300]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from editlift.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:400]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("bad", bad, "without sql", sorted(set(queries()) - set(oracles)), "orphans", sorted(set(oracles) - set(queries())))
