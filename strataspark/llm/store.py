"""Shared storage for intermediate tables and side files.

Executors may be lost at any time, so nothing here lives on one machine: intermediate tables are
written as Parquet below the folder named by ``spark.checkpoint.dir``, which all executors share.
Only a ``local[...]`` session without that setting gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate files; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        made = tempfile.mkdtemp(prefix="strataspark-")
        atexit.register(shutil.rmtree, made, True)
        _made[app] = f"file://{made}"
    return _made[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/strataspark/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataspark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_strataspark_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let extra columns of the input have any names: those that begin with ``__``, as the operators' own columns
    do, get others on the way in and their own back on the way out."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        clash = [c for c in docs.columns if c.startswith("__")]
        if not clash:
            return operator(docs, *args, **how)
        inner = dict(zip(clash, unused(docs, *[f"shield{i}" for i in range(len(clash))])))
        out = operator(docs.withColumnsRenamed(inner), *args, **how)
        return out.withColumnsRenamed({v: k for k, v in inner.items() if v in out.columns})

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that don't clash with those of ``df`` (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
