"""Run registered queries against their SQL on DuckDB: python tests/compare.py SF [name ...]."""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from touchline.plans import catalog
from touchline.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(d):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        if math.isnan(v):
            return ""
        return f"{v:.6g}" if abs(v) >= 1e-9 else "0"
    if isinstance(v, bool):
        return str(v)
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 1e6 else str(v)
    return str(v)


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def check(spark, con, d, name):
    df = catalog.QUERIES[name](spark, d)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        return len(got), None
    cur = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {df.columns} != {cols}"
    a, b = canon(got, df.columns), canon(want, cols)
    if len(a) != len(b):
        return len(got), f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return len(got), f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return len(got), "ok"


if __name__ == "__main__":
    d = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = local_session(), connect(d)
    names = [n for n in catalog.QUERIES if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    fails = 0
    for n in names:
        t = time.time()
        try:
            rows, res = check(spark, con, d, n)
        except Exception as exc:
            rows, res = -1, "ERROR " + str(exc)[:700]
        if res not in ("ok", None):
            fails += 1
        print(f"{time.time() - t:6.2f}s {n:38s} {rows:8d} {'rows-only' if res is None else res}", flush=True)
    print("failures:", fails, "of", len(names))
