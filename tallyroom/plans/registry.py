"""Queries by name; each callable takes (spark, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order are equal."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def day(c: str) -> Column:
    return F.unix_date(F.to_date(c)).cast("long")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def days_sql(c: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', CAST({c} AS DATE))"


def month(c: str) -> Column:
    return (F.year(c) * 12 + F.month(c) - 1).cast("long")


def month_sql(c: str) -> str:
    return f"CAST(year({c}) * 12 + month({c}) - 1 AS BIGINT)"
