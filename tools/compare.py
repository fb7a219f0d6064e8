"""Run registered queries and their comparison SQL side by side.

    python tools/compare.py [--sf DIR] [--cpus N] [name-prefix ...]
"""

import argparse
import datetime
import math
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

import duckdb

from vulnloom.plans import load_all
from vulnloom.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([norm(v) for v in value])
    return str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main():
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("--cpus", default="8")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    registry = load_all()
    spark = build_session(master=f"local[{opts.cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{opts.sf}/{t}.parquet'")
    failed = []
    for name, run in registry.QUERIES.items():
        if opts.names and not any(name.startswith(n) for n in opts.names):
            continue
        try:
            t0 = time.time()
            df = run(spark, opts.sf)
            cols, rows = table_of(df.columns, df.collect())
            t1 = time.time()
            if name not in registry.ORACLES:
                print(f"rows {name:45s} {len(rows):8d} {t1 - t0:6.2f}s", flush=True)
                continue
            result = con.sql(registry.ORACLES[name])
            ocols, orows = table_of(result.columns, result.fetchall())
            t2 = time.time()
            ok = cols == ocols and rows == orows
            print(f"{'ok  ' if ok else 'DIFF'} {name:45s} {len(rows):8d} {t1 - t0:6.2f}s oracle {t2 - t1:6.2f}s", flush=True)
            if not ok:
                failed.append(name)
                print("   columns", cols, ocols if cols != ocols else "")
                print("   counts", len(rows), len(orows))
                left, right = set(rows) - set(orows), set(orows) - set(rows)
                print("   only spark", len(left), [str(r)[:300] for r in sorted(left)[:3]])
                print("   only sql  ", len(right), [str(r)[:300] for r in sorted(right)[:3]])
        except Exception as error:
            failed.append(name)
            print(f"FAIL {name}: {str(error)[:700]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print("failed:", failed)


if __name__ == "__main__":
    main()
