"""Risk of files, their tests, and the files that matter most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions import names, paths


def rounded(x: Column) -> Column:
    """Half up for values that aren't negative."""
    return F.floor(x + 0.5)


def test_mapping(files: DataFrame) -> DataFrame:
    """(file, test_files): tests whose name without what marks it as a test is that of the file, in any directory."""
    tests = files.where(paths.is_test("path")).select(F.col("path").alias("test"), names.test_stem("path").alias("stem"))
    sources = files.where(~paths.is_test("path")).select(F.col("path").alias("file"), paths.stem("path").alias("stem"))
    return sources.join(tests, "stem").groupBy("file").agg(F.array_sort(F.collect_list("test")).alias("test_files"))


def risk_class(score: Column | str) -> Column:
    score = paths.col(score)
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def score(rows: DataFrame) -> DataFrame:
    """Adds ``raw``, ``score`` (0 to 100, relative to the greatest raw score) and ``risk`` to metrics of files:
    transitive_impact, fan_in, change_frequency, on_critical_path, has_tests."""
    raw = F.col("transitive_impact") * 3 + F.col("fan_in") * 2 + F.col("change_frequency") * 20 + F.when(F.col("on_critical_path"), 15).otherwise(0) - F.when(F.col("has_tests"), 10).otherwise(0)
    rows = rows.withColumn("raw", raw.cast("double"))
    # the greatest is one row, joined back; a window over everything would put all files in one task
    top = rows.agg(F.greatest(F.max("raw"), F.lit(1.0)).alias("__top"))
    out = rows.crossJoin(F.broadcast(top))
    s = F.greatest(F.lit(0), F.least(F.lit(100), rounded(F.col("raw") / F.col("__top") * 100))).cast("int")
    return out.withColumn("score", s).withColumn("risk", risk_class("score")).drop("__top")


def file_risks(files: DataFrame, impact: DataFrame, fan_in: DataFrame, critical: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """``file_risks``; support files are low with score 0, after the scores are normalised.

    ``frequency(path, frequency)`` is optional; without it change frequency counts as 0.
    """
    rows = files.select(F.col("path").alias("file"), "is_support")
    rows = rows.join(impact.select(F.col("node").alias("file"), F.col("impact")), "file", "left").join(fan_in.select(F.col("node").alias("file"), "fan_in"), "file", "left")
    on_path = critical.select(F.explode("files").alias("file")).distinct().withColumn("on_path", F.lit(True))
    rows = rows.join(on_path, "file", "left").join(test_mapping(files), "file", "left")
    rows = rows.join(frequency.select(F.col("path").alias("file"), "frequency"), "file", "left") if frequency is not None else rows.withColumn("frequency", F.lit(0.0))
    tests = F.coalesce("test_files", F.array().cast("array<string>"))
    rows = rows.select(
        "file", "is_support", F.coalesce("impact", F.lit(0)).cast("int").alias("transitive_impact"), F.coalesce("fan_in", F.lit(0)).cast("int").alias("fan_in"),
        F.coalesce("frequency", F.lit(0.0)).alias("change_frequency"), F.coalesce("on_path", F.lit(False)).alias("on_critical_path"), (F.size(tests) > 0).alias("has_tests"), tests.alias("test_files"),
    )
    out = score(rows).drop("raw")
    out = out.withColumn("score", F.when(F.col("is_support"), 0).otherwise(F.col("score"))).withColumn("risk", F.when(F.col("is_support"), "low").otherwise(F.col("risk")))
    return out.drop("is_support").select("file", "risk", "score", "transitive_impact", "fan_in", "change_frequency", "on_critical_path", "has_tests", "test_files")


def hot_files(risks: DataFrame, members: DataFrame, most: int = 15) -> DataFrame:
    """The ``most`` important files of score above 0, with their module."""
    importance = F.col("fan_in") * 2 + F.col("transitive_impact") + F.col("change_frequency") * 10
    # the module is joined after the limit, so only the rows that are kept are looked up
    top = risks.where("score > 0").withColumn("importance", importance.cast("double")).orderBy(F.desc("importance"), F.desc("score"), "file").limit(most)
    found = top.join(members.select(F.col("path").alias("file"), "module"), "file", "left")
    found = found.orderBy(F.desc("importance"), F.desc("score"), "file")
    return found.select("file", "importance", "risk", "fan_in", "transitive_impact", F.coalesce("module", F.lit("unknown")).alias("module"))
