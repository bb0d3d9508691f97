"""Run queries and their SQL side by side and compare rows.

Usage: python -m verification.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from verification.catalog import load_all


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("verification")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        # Without recording the Python call site of every expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


def normal(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, failed = local_session(), database(sf_dir), []
    for name, q in load_all().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            mine = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if q.sql is None:
                print(f"----  {name}: {len(mine)} rows, {took:.1f}s, no oracle")
                continue
            result = con.execute(q.sql)
            columns = [d[0] for d in result.description]
            theirs = result.fetchall()
            same_columns = sorted(columns) == sorted(df.columns)
            a, b = normal(mine, df.columns), normal(theirs, columns)
            ok = same_columns and a == b
            print(f"{'ok' if ok else 'FAIL':4}  {name}: {len(mine)} rows, {took:.1f}s, sql {time.time() - start - took:.1f}s")
            if not ok:
                failed.append(name)
                print("   columns", sorted(df.columns), sorted(columns), len(a), len(b))
                only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
                print("   spark only", only_a[:4], "\n   sql only  ", only_b[:4])
        except Exception as error:
            failed.append(name)
            print(f"FAIL  {name}: {type(error).__name__}: {str(error)[:600]}")
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(min(main(), 1))
