"""Compare registered queries with their SQL on one folder: python -m tests.oracle FOLDER [query ...]."""

from __future__ import annotations

import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connection(folder: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows(names: list[str], values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def compare(spark, con, folder: str, name: str, query, sql: str | None) -> str:
    started = time.time()
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return f"rows-only  {name:28s} {sum(got.values()):8d} rows {took:6.2f}s"
    started = time.time()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    sql_took = time.time() - started
    problems = []
    if sorted(names) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if got != want:
        problems.append(f"{sum(got.values())} vs {sum(want.values())} rows; only ours {list((got - want).items())[:3]}; "
                        f"only SQL {list((want - got).items())[:3]}")
    state = "MISMATCH" if problems else "ok" if want else "EMPTY"
    return f"{state:10s} {name:28s} {sum(got.values()):8d} rows {took:6.2f}s (sql {sql_took:.2f}s) {' | '.join(problems)}"


def main() -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    con, oracle = connection(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if not wanted or any(name.startswith(w) for w in wanted):
            try:
                print(compare(spark, con, folder, name, query, oracle.get(name)), flush=True)
            except Exception as error:  # noqa: BLE001 - report every query
                print(f"ERROR      {name}: {str(error)[:600]}", flush=True)


if __name__ == "__main__":
    main()
