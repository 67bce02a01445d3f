"""Where queries and the SQL that says what they must return are kept, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import compiled_plans, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under `name`."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(compiled_plans(use_utc(spark)), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def fx(value: Column, digits: int = 6) -> Column:
    """Cuts a double to `digits` decimals in a way any engine repeats bit by bit."""
    return F.floor(value.cast("double") * F.lit(float(10 ** digits)) + 0.5) / F.lit(float(10 ** digits))


def f32(value: Column, digits: int = 3) -> Column:
    return fx(value.cast("float"), digits)
