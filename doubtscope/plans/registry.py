"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows can be checked."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(c: Column | str, digits: int = 9) -> Column:
    """A double for comparison: rounded; NaN as -1 and +inf as 1e9, which never occur as values."""
    x = F.col(c) if isinstance(c, str) else c
    return (
        F.when(F.isnan(x), F.lit(-1.0)).when(x == F.lit(float("inf")), F.lit(1e9)).otherwise(F.round(x, digits))
    )
