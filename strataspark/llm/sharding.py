"""Operator 3: shards by proportional stratified interleaving.

Rows of each source are put in a seeded random order and ranked; the row of rank r of n gets the
fractional rank ``(r - 0.5) / n``. In the order of fractional ranks (then source) every
stretch holds the sources in their proportions, so cutting it into equal pieces gives shards whose mixture
is that of the whole to within one row a source.

Ranks need no task that holds a whole source: the seeded hash also deals the rows into buckets, a
bucket is ranked on its own, and the counts of the buckets before it (a small table) are added. Rows are then range-sorted
by fractional rank and written to the shared folder, and the place of a row follows from its place in its file and the rows
of the files before. So nothing depends on the number of sources: each document may have a source of its own, or all one.

Defined results: a null source is a source of its own; repeated rows are ranked next to each other;
rows that share a doc_id come in order of the hash of their text, where there is one; an empty
table gives no rows; with fewer rows than shards some shards are empty. Extra columns are carried along.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

SHARDS, SEED, BUCKET_DIGITS = 16, "strata-3", 3


def stratum(column: str) -> Column:
    """A source as a string that is never null and tells null from every name."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


def seeded(seed: str, column: str = "doc_id") -> Column:
    """Hex digest that orders rows at random; SQL engines agree on it."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(column).cast("string"), F.lit(""))))


def bucketed_running(df: DataFrame, group: str, order: list[str], bucket: str, total: str, offsets: DataFrame, weight: Column | None = None) -> DataFrame:
    """Adds ``total``: rank from 1 (or the sum of ``weight`` up to and with the row) within ``group``.

    ``offsets`` (group, bucket, before) has what the buckets before hold, see :func:`bucket_offsets`.
    """
    w = Window.partitionBy(group, bucket).orderBy(*order)
    local = F.row_number().over(w) if weight is None else F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(total, local.cast("long")).join(offsets, [group, bucket]).withColumn(total, F.col(total) + F.col("__before"))


def bucket_offsets(df: DataFrame, group: str, bucket: str, weight: Column | None = None) -> DataFrame:
    """(group, bucket, __before, __all): what the buckets of a group before this one hold together, and what all do."""
    totals = df.groupBy(group, bucket).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__held"))
    w = Window.partitionBy(group)
    before = F.sum("__held").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(group, bucket, F.coalesce(before, F.lit(0)).cast("long").alias("__before"), F.sum("__held").over(w).cast("long").alias("__all"))


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df``, whose partitions are in order, written and read back with the place of each row from 1 in ``name``; and its rows.

    The place is that of the row in its file plus the rows of the files before, which are named in the order of partitions.
    """
    cut = store.cut(df, "ordered")
    file = F.col("_metadata.file_name")
    counts = {r[0]: r[1] for r in cut.groupBy(file).count().collect()}
    before, rows = 0, []
    for f in sorted(counts, key=lambda f: [int(x) for x in re.findall(r"^part-(\d+)|-c(\d+)\.", f) for x in x if x]):
        rows.append((f, before))
        before += counts[f]
    spark = df.sparkSession
    if not rows:
        return cut.withColumn(name, F.lit(0).cast("long")), 0
    # one row a file
    offsets = spark.createDataFrame(rows, "__file string, __first long")
    placed = cut.withColumn("__file", file).withColumn("__row", F.col("_metadata.row_index")).join(F.broadcast(offsets), "__file")
    return placed.withColumn(name, F.col("__first") + F.col("__row") + 1).drop("__file", "__first", "__row"), before


@store.shielded
def sharded(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, source: str = "source", digits: int = BUCKET_DIGITS) -> DataFrame:
    """``docs`` with ``position`` (from 1, in the interleaved order) and ``shard`` (from 0).

    Columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop("position", "shard")
    g, h, b, r, f = store.unused(docs, "__g", "__h", "__b", "__r", "__f")
    keyed = docs.withColumn(g, stratum(source)).withColumn(h, seeded(seed)).withColumn(b, F.substring(h, 1, digits))
    light = docs.select("doc_id", source).select(stratum(source).alias(g), F.substring(seeded(seed), 1, digits).alias(b))
    tie = [F.xxhash64("text")] if "text" in docs.columns else []
    ranked = bucketed_running(keyed, g, [h, "doc_id", *tie], b, r, bucket_offsets(light, g, b))
    ordered = ranked.withColumn(f, (F.col(r) - 0.5) / F.col("__all")).repartitionByRange(f, g).sortWithinPartitions(f, g)
    out, n = numbered(ordered.drop(g, h, b, r, f, "__before", "__all"), "position")
    return out.withColumn("shard", F.floor((F.col("position") - 1) * shards / F.lit(max(1, n))).cast("int"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return sharded(docs).select("doc_id", "source", "position", "shard")


OP3_SQL = f"""
WITH k AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS g,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT doc_id, source, g, h, (row_number() OVER (PARTITION BY g ORDER BY h, doc_id) - 0.5::DOUBLE) / (count(*) OVER (PARTITION BY g))::DOUBLE AS f FROM k),
p AS (SELECT doc_id, source, row_number() OVER (ORDER BY f, g) AS position, count(*) OVER () AS n FROM r)
SELECT doc_id, source, CAST(position AS BIGINT) AS position, CAST(floor((position - 1) * {SHARDS} / n::DOUBLE) AS INTEGER) AS shard FROM p
"""
