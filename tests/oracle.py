"""Compare the registered queries with their SQL on the test tables.

Run directly: python tests/oracle.py [scale] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def folder(scale: str = "0.01") -> str:
    return f"/root/testdata/sf{scale}"


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, bool) or value is None:
            return str(value)
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return str(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def reference(sql: str, path: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    types = [str(d[1]) for d in found.description]
    return columns, types, found.fetchall()


def compare(spark, name: str, path: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, path)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return bool(rows), f"{len(rows)} rows, no SQL"
    columns, types, want = reference(sql, path)
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = canonical(df.columns, rows), canonical(columns, want)
    if a == b:
        return True, f"{len(a)} rows"
    extra, missing = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
    return False, f"{len(a)} rows vs {len(b)}; only Spark {extra}; only SQL {missing}; types {df.dtypes} {types}"


if __name__ == "__main__":
    sys.path.insert(0, ROOT)
    from pyspark.sql import SparkSession

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    bad = 0
    for name in sys.argv[2:] or list(entry.queries()):
        began = time.time()
        try:
            ok, note = compare(spark, name, folder(scale))
        except Exception as problem:  # keep going, report at the end
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, f"{time.time() - began:.1f}s", note, flush=True)
    print("failed:", bad)
