"""What changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIER_ORDER = {"observation": 0, "convention": 1, "rule": 2}


def added(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    return after.select(*keys).distinct().join(before.select(*keys).distinct(), keys, "left_anti")


def delta_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, src, dst): edges that are new or removed."""
    keys = ["src", "dst"]
    return added(before, after, keys).select(F.lit("new").alias("change"), *keys).union(added(after, before, keys).select(F.lit("removed"), *keys))


def delta_modules(before: DataFrame, after: DataFrame) -> DataFrame:
    return added(before, after, ["id"]).select(F.lit("new").alias("change"), "id").union(added(after, before, ["id"]).select(F.lit("removed"), "id"))


def delta_risk(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, before, after) of files in both whose class differs."""
    b, a = before.select("file", F.col("risk").alias("before")), after.select("file", F.col("risk").alias("after"))
    return b.join(a, "file").where("before <> after")


def tier_order(tier: str):
    return F.create_map(*[F.lit(x) for p in TIER_ORDER.items() for x in p])[F.col(tier)]


def delta_rules(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rules added, removed, promoted, demoted, by id."""
    b, a = before.select("id", tier_order("tier").alias("tb")), after.select("id", tier_order("tier").alias("ta"))
    count = lambda c: F.coalesce(F.sum(F.when(F.expr(c), 1).otherwise(0)), F.lit(0)).cast("long")
    return b.join(a, "id", "full").agg(count("tb is null").alias("added"), count("ta is null").alias("removed"), count("ta > tb").alias("promoted"), count("ta < tb").alias("demoted"))
