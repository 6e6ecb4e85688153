"""Compare registered queries with their oracle SQL: rows as multisets, columns by name."""

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, f, sql, sf_dir, con=None):
    """An empty string if both give the same rows, else what differs."""
    con = con or connect(sf_dir)
    df = f(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return ""
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return f"{len(got[1])} and {len(want[1])} rows; only in Spark {sorted(a - b)[:3]}; only in the oracle {sorted(b - a)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    from pyspark.sql import SparkSession

    from siftline.plans import bindings

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    d = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(d)
    for name, f in bindings.QUERIES.items():
        if len(sys.argv) > 1 and not any(a in name for a in sys.argv[1:]):
            continue
        t = time.time()
        try:
            said = compare(spark, name, f, bindings.ORACLE_SQL[name], d, con) if name in bindings.ORACLE_SQL else f"rows only: {f(spark, d).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name} {time.time() - t:.1f}s {said or 'same'}", flush=True)
