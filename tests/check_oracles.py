"""Run registered queries next to their SQL: python tests/check_oracles.py [sf] [name ...]"""

import datetime
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import __spark_entry__ as entry  # noqa: E402
from portolan.queries.views import BASE  # noqa: E402
from portolan.session import local_session  # noqa: E402


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main(sf, names):
    folder = f"/root/testdata/{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        t0 = time.time()
        try:
            df = queries[name](spark, folder)
            got = df.collect()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: spark {str(e)[:400]}", flush=True)
            continue
        took = time.time() - t0
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        t0 = time.time()
        try:
            cur = con.execute(oracles[name])
            cols = [c[0] for c in cur.description]
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: duckdb {str(e)[:400]}", flush=True)
            continue
        took2 = time.time() - t0
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if sorted(df.columns) != sorted(cols) or a != b:
            bad.append(name)
            sa, sb = set(a), set(b)
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; cols {sorted(df.columns)} vs {sorted(cols)}")
            print("   only spark ", str([x for x in a if x not in sb][:3])[:700])
            print("   only duckdb", str([x for x in b if x not in sa][:3])[:700], flush=True)
        else:
            print(f"{'ok  ' if a else 'EMPTY'} {name}: {len(a)} rows {took:.1f}s / {took2:.1f}s", flush=True)
    print(f"{len(bad)} bad: {' '.join(bad)}")


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    main(sf, args)
