"""Incremental scans: only files whose content changed are parsed again.

Change is told by a hash of the content, so edits count whether staged or not. The same step serves a stream of
arriving files: :func:`refresh` runs in ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.sources.extract import parsed


def content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash", F.xxhash64("content"))


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache (path, hash, ...) doesn't have with this content."""
    return content_hash(files).join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def rescan(files: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Parse results with hashes: cached ones of files that are as they were, fresh ones of the others; results
    of files that are gone are dropped."""
    hashed = content_hash(files)
    if cache is None:
        fresh = hashed
    else:
        fresh = changed(files, cache)
    out = parsed(fresh).join(fresh.select("path", "hash"), "path")
    if cache is not None:
        out = out.unionByName(cache.join(hashed.select("path", "hash"), ["path", "hash"], "left_semi").select(*out.columns))
    return out


def refresh(files: DataFrame, cache_path: str, run: str) -> DataFrame:
    """Write the next cache below ``cache_path`` and give it. A run that is repeated reads the same previous cache."""
    spark = files.sparkSession
    marker = f"{cache_path}/latest"
    try:
        last = spark.read.text(marker).first()[0]
    except Exception:  # the first run
        last = None
    if last == run:
        return spark.read.parquet(f"{cache_path}/{run}")
    cache = spark.read.parquet(f"{cache_path}/{last}") if last else None
    rescan(files, cache).write.mode("overwrite").parquet(f"{cache_path}/{run}")
    spark.createDataFrame([(run,)], "v string").coalesce(1).write.mode("overwrite").text(marker)
    _prune(spark, cache_path, {run, last, "latest"})
    return spark.read.parquet(f"{cache_path}/{run}")


def _prune(spark: SparkSession, path: str, keep: set[str | None]) -> None:
    """Delete what lies below a folder but for some names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in system.listStatus(at):
        if entry.getPath().getName() not in keep:
            system.delete(entry.getPath(), True)


def stream(files, cache_path: str):
    """A streaming query that merges arriving (path, language, is_support, content) rows into the cache.

    Each batch adds or replaces its own files; the cache of batch n is the one of batch n - 1 with those.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        now = content_hash(batch.dropDuplicates(["path"]))
        fresh = parsed(now).join(now.select("path", "hash"), "path")
        out = fresh
        if n:
            old = spark.read.parquet(f"{cache_path}/batch-{n - 1}")
            out = fresh.unionByName(old.join(now.select("path"), "path", "left_anti").select(*fresh.columns))
        out.write.mode("overwrite").parquet(f"{cache_path}/batch-{n}")

    return files.writeStream.foreachBatch(merge)
