"""Where queries and the SQL they are held against are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its name, with DuckDB SQL for the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def exact_mean(x: Column | str) -> Column:
    """Mean of numbers of at most six decimal places from their exact sum: the order of the rows does not change it."""
    x = F.col(x) if isinstance(x, str) else x
    return F.sum(x.cast("decimal(28,6)")).cast("double") / F.count(x)


def r6(x: Column | str, places: int = 6) -> Column:
    """Rounded as DuckDB rounds (scaled, half away from zero), so that ties fall alike; without a negative zero."""
    scale = 10.0**places
    return F.round((F.col(x) if isinstance(x, str) else x) * scale) / scale + F.lit(0.0)
