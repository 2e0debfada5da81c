"""Run queries against DuckDB: python check.py [sf] [name ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from visitframe.plans.catalog import CATALOG
from visitframe.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(CATALOG)
    folder = f"/root/testdata/{sf}"
    spark = local_session(int(__import__("os").environ.get("CHECK_CPUS", "8")))
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name in names:
        q = CATALOG[name]
        try:
            t0 = time.time()
            got = [tuple(r) for r in q.plan(spark, folder).collect()]
            t1 = time.time()
            if q.sql is None:
                print(f"ROWS {name} rows={len(got)} spark={t1 - t0:.1f}s {got[:2]}", flush=True)
                continue
            want = db.execute(q.oracle()).fetchall()
            t2 = time.time()
            got.sort(key=key)
            want.sort(key=key)
            ok = len(got) == len(want) and all(all(map(same, a, b)) for a, b in zip(got, want))
            print(f"{'OK  ' if ok else 'DIFF'} {name} rows={len(got)}/{len(want)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                diff = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))][:3]
                for a, b in diff:
                    print("   spark", a, "\n   sql  ", b)
                print(f"   differing rows: {sum(not all(map(same, a, b)) for a, b in zip(got, want))}", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
            if len(names) == 1:
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main()
