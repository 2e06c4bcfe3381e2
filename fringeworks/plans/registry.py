"""Queries by name with their SQL; doubles are rounded alike in both, as sums depend on their order in the last digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> Callable[[Query], Query]:
    """Registers a query under its function's name; doubles: the columns to round."""
    names = doubles.split()
    # decimal inputs give results that lie right between two steps: all are moved off by far less than a step and far more than a sum's error
    tie = 0.0003 * 10.0**-digits

    def keep(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.round(F.col(c) + tie, digits) + 0.0 for c in names})

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = f"select * replace ({', '.join(f'round({c} + {tie!r}, {digits}) + 0.0 as {c}' for c in names)}) from ({sql})" if names else sql
        return f

    return keep
