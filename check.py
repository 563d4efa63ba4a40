"""Compare registered queries with their DuckDB twins: python check.py [sf] [name part ...]."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name, fn, sql, sf):
    start = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no twin", took
    start = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    took_sql = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    left, right = _rows(df.columns, got), _rows(names, want)
    note = f"{len(left)} rows (duckdb {took_sql:.1f}s)"
    if left != right:
        in_left, in_right = set(left), set(right)
        a = [r for r in left if r not in in_right][:3]
        b = [r for r in right if r not in in_left][:3]
        return False, f"{len(left)} vs {len(right)} rows\n    spark  {str(a)[:900]}\n    duckdb {str(b)[:900]}", took
    return True, note, took


def main():
    from clausewise.session import get_spark
    from queries import REGISTRY

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    base = os.environ.get("TESTDATA", "/root/testdata") + f"/sf{sf}"
    conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp()}
    spark = get_spark(master="local[8]", conf=conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    bad = 0
    for name, (fn, sql) in REGISTRY.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, sql, base)
        except Exception as error:  # report and go on with the next query
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
