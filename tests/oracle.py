"""Run registered queries against their SQL on DuckDB and report differences.

    python tests/oracle.py [name ...]      (default: all)
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got[1])}", took, True
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", took, False
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} != {len(want[1])}\n   got {got[1][:3]}\n  want {want[1][:3]}", took, False
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"VALUES differ in {len(bad)} of {len(want[1])}: {got[0]}\n   got {bad[0][0]}\n  want {bad[0][1]}", took, False
    kinds = {type(a) is type(b) for a, b in zip(got[1][0], want[1][0])} if want[1] else {True}
    note = "" if kinds == {True} else f" TYPES {[(type(a).__name__, type(b).__name__) for a, b in zip(got[1][0], want[1][0])]}"
    return f"ok {len(want[1])} rows{note}" + ("" if want[1] else " EMPTY"), took, not note


def main(names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    fails = []
    for name in names or qs:
        for key in [k for k in qs if k == name or (name.endswith("*") and k.startswith(name[:-1]))]:
            try:
                text, took, ok = compare(spark, con, key, qs[key], os_.get(key), sf_dir)
            except Exception as e:  # report and go on
                text, took, ok = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0.0, False
            print(f"{'PASS' if ok else 'FAIL'} {key} {took:.1f}s {text}", flush=True)
            if not ok:
                fails.append(key)
    print(f"{len(fails)} failures: {fails}")


if __name__ == "__main__":
    main(sys.argv[1:])
