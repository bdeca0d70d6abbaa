"""Registry of the runnable queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round the double columns (and turn -0.0 into 0.0), so engines that add in another order still agree."""

    def fix(name: str, kind: str) -> Column:
        if kind in ("double", "float") and (only is None or name in only):
            return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)
        return F.col(name)

    return df.select(*[fix(n, k) for n, k in df.dtypes])


def rnd(expr: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"
