"""Runs every query and its SQL on one data directory and compares all values.

    python tests/check_oracles.py [data directory] [query name ...]
"""

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus="8"):
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def database(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def compare(spark, con, name, sf):
    """None when equal, else what differs."""
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    con.execute(sql)
    names = [d[0] for d in con.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in con.fetchall()), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; {got[:1]} {want[:1]}"
    bad = [(g, w) for g, w in zip(got, want) if not _same(g, w)]
    return f"{len(bad)} of {len(got)} rows differ: {bad[0]}"[:1500] if bad else None


def _same(got, want):
    return all(
        g == w or (isinstance(g, float) and isinstance(w, float) and math.isnan(g) and math.isnan(w))
        for g, w in zip(got, want)
    )


if __name__ == "__main__":
    data = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = database(data)
    failed = 0
    for query in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, con, query, data)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        failed += problem is not None
        print(f"{query:30} {time.time() - start:6.2f}s {problem or 'equal'}", flush=True)
    print("failed:", failed)
    sys.exit(failed > 0)
