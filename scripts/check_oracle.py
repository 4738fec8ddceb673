"""Compare registered queries with their SQL in DuckDB: check_oracle.py [folder] [name-prefix ...]."""

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from bookweave.plans.catalog import load
from bookweave.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "as_tuple") and not isinstance(value, (str, int)):
        return float(value)
    return value


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in rows))


def strict(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    for r in rows:
        values = [r[i] for i in order]
        yield tuple(float(v) if hasattr(v, "as_tuple") else (v + 0.0 if isinstance(v, float) else v) for v in values)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name, q in load().items():
        if wanted and not any(name.startswith(w) or w in q.ids.split() for w in wanted):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, folder)
            rows = df.collect()
            took = time.time() - t0
            if q.sql is None:
                print(f"rows {name} {len(rows)} {took:.1f}s", flush=True)
                if not rows:
                    bad.append(name)
                continue
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            a, b = canon(rows, df.columns), canon(want, cols)
            same = sorted(df.columns) == sorted(cols) and a == b
            exact = same and sorted(map(repr, strict(rows, df.columns))) == sorted(map(repr, strict(want, cols)))
            note = ("" if exact else "  (equal after rounding only)") if same else f" cols {sorted(set(df.columns) ^ set(cols))} n {len(a)}/{len(b)}"
            print(f"{'OK  ' if same else 'DIFF'} {name} {len(rows)} {took:.1f}s{note}", flush=True)
            if not rows:
                print("     (no rows)")
            if not same:
                bad.append(name)
                left, right = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
                print("   spark", sorted(df.columns), *left, sep="\n     ")
                print("   duck ", *right, sep="\n     ", flush=True)
        except Exception as e:
            bad.append(name)
            text = traceback.format_exc()
            print(f"FAIL {name}: {str(e)[:700]}\n   at {[l for l in text.splitlines() if 'plans' in l or 'operators' in l][-2:]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
