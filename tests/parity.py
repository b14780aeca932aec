"""Runs queries in Spark and their SQL in DuckDB, and compares rows: python -m tests.parity SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} {len(want)}"
    return next((f"{a} {b}" for a, b in zip(got, want, strict=True) if a != b), "")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    oracles, queries = entry.oracle_sql(), entry.queries()
    bad = 0
    con = duck(sys.argv[1])
    for name in sys.argv[2:] or oracles:
        began = time.time()
        try:
            said = compare(session, con, queries[name], oracles[name], sys.argv[1])
        except Exception as problem:
            said = repr(problem)[:600]
        if said:
            bad += 1
            print("BAD", name, said[:600], flush=True)
        elif time.time() - began > 5:
            print("slow", name, round(time.time() - began, 1), flush=True)
    print("done", bad)
