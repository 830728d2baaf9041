"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}
MODULES = ["filters", "versioned", "relational", "scalar", "tpch", "statistics", "engine", "streams", "inventory", "encodings"]


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and its SQL if there is one."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict, dict[str, str]]:
    for m in MODULES:
        import_module(f"lamina.plans.{m}")
    return QUERIES, SQL
