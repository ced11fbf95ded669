"""Compare registered queries with their SQL in DuckDB, ignoring row order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return str(decimal.Decimal(v).normalize() + 0)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "s:" + str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, q, sf_dir):
    """None when equal, else a short description of the difference."""
    df = q.run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if q.sql is None:
        return None if got else "no rows"
    res = con.execute(q.sql)
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got == want:
        return None if got else "EMPTY on both sides"
    extra = [r for r in got if r not in set(want)][:2]
    missing = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)}; extra {extra}; missing {missing}"


if __name__ == "__main__":
    from quadrille.plans.catalogue import QUERIES
    from quadrille.session import local_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    picks = sys.argv[1:]
    bad = 0
    total = 0
    for name, q in QUERIES.items():
        if picks and not any(name == p or q.run.__module__ == p or q.module == p for p in picks):
            continue
        total += 1
        t0 = time.time()
        try:
            d = compare(spark, con, q, sf)
        except Exception as e:  # report and go on
            d = f"{type(e).__name__}: {str(e)[:700]}"
        dt = time.time() - t0
        if d:
            bad += 1
            print(f"BAD {name} ({dt:.1f}s): {d[:1200]}", flush=True)
        elif dt > 12:
            print(f"slow {name} {dt:.1f}s rows-only={q.sql is None}", flush=True)
    print(f"{total - bad} ok, {bad} bad")
