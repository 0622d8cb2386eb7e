"""Run every registered query in Spark and its oracle SQL in DuckDB and
compare row counts, column names and order-insensitive values.

usage: python tests/check_oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as E  # noqa: E402
from glossa.session import get_session  # noqa: E402

EXACT = bool(int(__import__("os").environ.get("EXACT", "0")))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 6)
    return v


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = []
    for k in keys or list(qs):
        t0 = time.time()
        df = qs[k](spark, sf)
        rows = [tuple(norm(x) for x in r) for r in df.collect()]
        t1 = time.time()
        cols = df.columns
        if k not in sqls:
            print(f"{k:22s} spark {t1-t0:6.1f}s rows={len(rows)} (no oracle)")
            continue
        res = con.execute(sqls[k])
        ocols = [d[0] for d in res.description]
        orows = [tuple(norm(x) for x in r) for r in res.fetchall()]
        t2 = time.time()
        ok_cols = sorted(cols) == sorted(ocols)
        if ok_cols:
            perm = [ocols.index(c) for c in cols]
            orows = [tuple(r[i] for i in perm) for r in orows]
        key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
        same = ok_cols and sorted(rows, key=key) == sorted(orows, key=key)
        status = "OK" if same else "MISMATCH"
        if not same:
            bad.append(k)
        print(f"{k:22s} spark {t1-t0:6.1f}s duck {t2-t1:6.1f}s rows={len(rows)}/{len(orows)} {status}"
              + ("" if ok_cols else f" cols {cols} vs {ocols}"))
        if not same and ok_cols:
            a, b = set(rows), set(orows)
            print("   only spark:", sorted(a - b, key=key)[:3])
            print("   only duck: ", sorted(b - a, key=key)[:3])
        print("   schema:", df.schema.simpleString()[:200], "|", [d[1] for d in res.description][:8])
    print("MISMATCHES:", bad)


if __name__ == "__main__":
    main()
