"""Run a query in Spark and its SQL in DuckDB and compare the results as bags of rows."""

from __future__ import annotations

import glob
import os

import duckdb

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    types = [(n, str(table.schema.field(n).type).replace("large_string", "string")) for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    return types, sorted(zip(*columns), key=repr)


def differences(spark_table, sql_table, tolerance: float = 0.0) -> list[str]:
    spark_types, spark_rows = rows_of(spark_table)
    sql_types, sql_rows = rows_of(sql_table)
    found = []
    if spark_types != sql_types:
        found.append(f"types {sorted(set(spark_types) ^ set(sql_types))}")
    if len(spark_rows) != len(sql_rows):
        found.append(f"rows {len(spark_rows)} != {len(sql_rows)}")
    elif spark_rows != sql_rows:
        pairs = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
        found.append(f"{len(pairs)} of {len(spark_rows)} rows differ, first {pairs[0]}")
    return found
