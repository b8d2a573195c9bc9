"""Queries by name, each with the SQL that an independent engine checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, tables) under its name; tables(name) reads one, tables(name, stream=True) as a stream."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def tables(name: str, stream: bool = False) -> DataFrame:
                table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                # a stream reads a folder or a pattern, and a table may be a single file
                return spark.readStream.schema(table.schema).parquet(f"{sf_dir}/{name}.parque[t]") if stream else table

            return function(spark, tables)

        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add
