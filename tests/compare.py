"""Runs registered queries beside their SQL and compares the rows. python -m tests.compare DIR [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, (float,)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(plain(x) for x in v) + "]"
        if isinstance(v, dict):
            return "{" + ",".join(plain(x) for x in v.values()) + "}"
        return str(v)

    return sorted("|".join(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    got, c1 = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, c2 = rows_of([d[0] for d in cur.description], cur.fetchall())
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if c1 != c2:
        return f"columns {c1} against {c2}", len(got), kinds, df.dtypes
    if got != want:
        odd = [x for x in set(got) ^ set(want)]
        return f"{len(got)} rows against {len(want)}; {len(odd)} differ: " + " || ".join([*[f"S {x}" for x in got if x in set(odd)][:2], *[f"D {x}" for x in want if x in set(odd)][:2]]), len(got), kinds, df.dtypes
    return "", len(got), kinds, df.dtypes


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, ".")
    from quarry.plans.catalogue import QUERIES, SQL
    from quarry.plans.ship import ship

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    con = duck(sf_dir)
    for name in names or QUERIES:
        t = time.time()
        try:
            if name in SQL:
                bad, n, kinds, types = compare(spark, con, sf_dir, name, QUERIES[name], SQL[name])
                pairs = {c: (t, kinds.get(c)) for c, t in types}
                simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
                odd = {c: v for c, v in pairs.items() if v[0] in simple and v[1] is not None and simple[v[0]] != v[1] and v[1] not in ("NUMBER", "STRING")}
                print(f"{'FAIL' if bad else 'ok  '} {name} {n} rows {time.time() - t:.1f} s {bad} {odd if odd else ''}", flush=True)
            else:
                print(f"rows {name} {QUERIES[name](spark, sf_dir).count()} rows {time.time() - t:.1f} s", flush=True)
        except Exception as e:
            print(f"FAIL {name} {type(e).__name__} {str(e)[:700]}", flush=True)
