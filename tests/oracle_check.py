"""Run registered queries on Spark and their SQL on DuckDB over the same files and compare the rows.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""
from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v!r}"
    if v is None:
        return "null"
    return f"{type(v).__name__}:{v}"


def compare(df, con, sql):
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    b = cur.fetchall()
    if sorted(names) != cols:
        return f"columns differ: spark {cols} duckdb {sorted(names)}", len(b)
    pos = [names.index(c) for c in cols]
    left = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    right = sorted(tuple(norm(r[i]) for i in pos) for r in b)
    if left == right:
        return None, len(left)
    sl, sr = set(left), set(right)
    return (f"rows {len(left)} vs {len(right)}; only spark {sorted(sl - sr)[:3]}; only duckdb {sorted(sr - sl)[:3]} "
            f"cols {cols}"), len(left)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as entry
    from wiresift.session import local_session
    spark = local_session()
    d = f"/root/testdata/sf{a.sf}"
    con = duck(d)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for n, fn in qs.items():
        if a.names and not any(n.startswith(x) for x in a.names):
            continue
        t = time.time()
        try:
            if n in sql:
                err, rows = compare(fn(spark, d), con, sql[n])
            else:
                err, rows = None, fn(spark, d).count()
        except Exception as e:  # noqa: BLE001 - the report is the point
            err, rows = f"{type(e).__name__}: {str(e)[:700]}", -1
        kind = "sql " if n in sql else "rows"
        print(f"{'ok  ' if not err else 'FAIL'} {kind} {n} rows={rows} {time.time() - t:.2f}s {err or ''}", flush=True)
        bad += bool(err)
    print("failures:", bad)


if __name__ == "__main__":
    main()
