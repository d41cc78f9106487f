"""Run every registered query and its SQL and compare all values.

    python -m tests.compare [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connection(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _clean(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if value is None:
        return "null"
    return f"{type(value).__name__}:{value!r}"


def normal_form(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_clean(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, query, sql) -> tuple[bool, str]:
    started = time.time()
    found = query(spark, folder)
    rows = [tuple(r) for r in found.collect()]
    spent = time.time() - started
    if sql is None:
        return True, f"{spent:6.2f}s rows {len(rows)} (no SQL)"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(names) != sorted(found.columns):
        return False, f"columns {sorted(found.columns)} != {sorted(names)}"
    left, right = normal_form(found.columns, rows), normal_form(names, wanted)
    if left == right:
        return True, f"{spent:6.2f}s rows {len(rows)}"
    differ = [(a, b) for a, b in zip(left, right) if a != b][:3]
    return False, f"rows {len(left)} / {len(right)}; first differences {differ}"


def main(folder="/root/testdata/sf0.01", *only):
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    sqls, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            same, note = compare(spark, con, folder, name, query, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            same, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not same
        print("ok  " if same else "FAIL", name, note, flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main(*sys.argv[1:])
