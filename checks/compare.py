"""Run every query next to its SQL: ``python -m checks.compare [folder] [name ...]``."""
from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("psephos")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def key(row: tuple) -> tuple:
        return tuple((value is None, str(value)) for value in row)

    return sorted((tuple(row[i] for i in order) for row in rows), key=key)


def differences(spark_rows, spark_names, sql_rows, sql_names) -> str:
    """An empty text if both give the same columns and the same rows, else what differs first."""
    if sorted(spark_names) != sorted(sql_names):
        return f"columns {sorted(spark_names)} / {sorted(sql_names)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} / {len(sql_rows)}"
    pairs = zip(_sorted_rows(spark_names, spark_rows), _sorted_rows(sql_names, sql_rows))
    for left, right in pairs:
        for a, b in zip(left, right):
            same = a == b or (
                isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b)
            )
            if not same or (a is not None and type(a) is not type(b)):
                return f"{left} / {right}"
    return ""


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    chosen = arguments[1:] or list(QUERIES)
    spark, connection = local_session(), connect(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            result = QUERIES[name](spark, folder)
            rows = [tuple(row) for row in result.collect()]
        except Exception as problem:
            bad += 1
            print(f"FAIL {name}: {str(problem)[:1500]}", flush=True)
            continue
        seconds = time.time() - start
        verdict = "no SQL"
        if name in ORACLES:
            try:
                sql = connection.execute(ORACLES[name])
                names = [column[0] for column in sql.description]
                verdict = differences(rows, result.columns, sql.fetchall(), names) or "same"
            except Exception as problem:
                verdict = f"SQL: {str(problem)[:1500]}"
            bad += verdict != "same"
        print(f"{seconds:7.2f}s {name} ({len(rows)} rows): {verdict[:900]}", flush=True)
    print(f"{len(chosen)} queries, {bad} not as expected")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
