"""The list of registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r4(c: Column | str) -> Column:
    """Four decimals, without a negative zero: the form in which both engines compare."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 4) + F.lit(0.0)


def sql_r4(expression: str) -> str:
    return f"(round(({expression})::DOUBLE, 4) + 0.0)"


def with_tables(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
