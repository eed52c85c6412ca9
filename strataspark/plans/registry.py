"""The reference queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.plans.derived import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the driver's tables under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        own = name or f.__name__
        QUERIES[own] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[own] = sql
        return f

    return add


def rounded(c: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(c)
