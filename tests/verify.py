"""python -m tests.verify [name ...]: every query against its SQL, as the driver compares them."""

import math
import os
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def compare(spark, sf, name, q, sql):
    df = q(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} and {sorted(cols)}"
    want = rows_of(cols, cur.fetchall())
    if got != want:
        odd = [x for x in zip(got, want) if x[0] != x[1]][:2]
        return len(got), f"{len(got)} and {len(want)} rows; {str(odd)[:400]}"
    return len(got), None


def main():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql, names = oracle_sql(), sys.argv[1:]
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    for name, q in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            n, why = compare(spark, sf, name, q, sql.get(name))
        except Exception as e:  # noqa: BLE001
            n, why = -1, f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{'ok ' if not why else 'BAD'} {name} {n} rows {time.time() - t:.1f} s{'' if name in sql else ' (rows only)'} {why or ''}", flush=True)


if __name__ == "__main__":
    main()
