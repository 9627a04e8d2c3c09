"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(t) -> DataFrame, where t(name) reads a table; ``sql`` is its oracle."""

    def add(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def t(table: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{table}.parquet")

            t.spark, t.dir = spark, sf_dir
            return f(t)

        run.__name__ = key
        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add
