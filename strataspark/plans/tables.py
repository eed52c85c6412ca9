"""Intermediate tables in the folder that all executors share.

Loops cut their lineage by writing a table and reading it back, so that a lost executor costs no recomputation
beyond its own tasks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only for a local session that doesn't set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        made = tempfile.mkdtemp(prefix="strata-")
        atexit.register(shutil.rmtree, made, True)
        _made[app] = f"file://{made}"
    return _made[app]


#: For plans over a few thousand rows, whose cost is that of planning: no revision at run time, no compiled code, few partitions.
LIGHT = {
    "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN",
    "strata.light": "true",
}


def light_session(spark: SparkSession) -> SparkSession:
    """A session of its own beside ``spark`` for small inputs; the settings of ``spark`` stay as they are."""
    out = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        out.conf.set(key, spark.conf.get(key))
    for key, value in LIGHT.items():
        out.conf.set(key, value)
    return out


def light(spark: SparkSession) -> bool:
    return spark.conf.get("strata.light", "false") == "true"


#: Rows that are given to a task to sort or to hold.
SHARE = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys in as many partitions as its number of rows asks for, so that a task's memory doesn't grow with the input where the
    session's number of partitions doesn't."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SHARE)), *keys)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once: written below the shared folder and read back, or, in a light session, held as a local relation, which is
    what its few rows come to."""
    spark = df.sparkSession
    if light(spark):
        return spark.createDataFrame(df.toArrow(), df.schema)
    path = f"{shared_dir(spark)}/strata/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ordinal(df: DataFrame, major: list[str], minor: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the place of each row, from 1, in the order of ``major`` then ``minor``.

    Rows are only sorted within a value of ``major``; the counts before it come from a running sum over one row a value.
    """
    totals = df.groupBy(*major).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*major).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(c).alias(f"__{c}") for c in major], before.alias("__before"))
    local = F.row_number().over(Window.partitionBy(*major).orderBy(*minor))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in major]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.withColumn("__local", local).join(totals, on).withColumn(name, (F.col("__local") + F.col("__before")).cast("long")).drop("__local", "__before", *[f"__{c}" for c in major])


def first(order: Column | str, *partition: str) -> Column:
    """Rank of a row within its group; 1 is the first."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(order))
