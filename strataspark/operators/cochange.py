"""Files that change together: market-basket mining over ``commit_files(hash, path)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions import paths
from strataspark.plans.tables import cut

SOURCE = r"\.(go|java|jsx?|php|py|rb|rs|tsx?)$"


def file_counts(commit_files: DataFrame) -> DataFrame:
    """(path, commits) over all commits, bulk ones too."""
    return commit_files.select("hash", "path").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("commits"))


def pairs(commit_files: DataFrame, bulk: int = 20, source: str | None = SOURCE) -> DataFrame:
    """(hash, file_a, file_b) of each commit of ``bulk`` source files at most; pairs of one directory only where their extensions differ.

    The files of a commit are gathered once and paired from that array: one shuffle, where a self-join takes two,
    and an array has ``bulk`` entries at most, since larger commits are dropped before.
    """
    own = commit_files.select("hash", "path")
    return _paired(sets(own.where(F.col("path").rlike(source)) if source else own), bulk)


def sets(commit_files: DataFrame) -> DataFrame:
    """(hash, files): each file of a commit once."""
    return commit_files.groupBy("hash").agg(F.collect_set("path").alias("files"))


def _paired(sets: DataFrame, bulk: int) -> DataFrame:
    a = sets.where(F.size("files").between(2, bulk)).select("hash", F.array_sort("files").alias("files"))
    a = a.select("hash", "files", F.posexplode("files").alias("i", "file_a"))
    both = a.select("hash", "file_a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("file_b"))
    apart = (paths.dirname("file_a") != paths.dirname("file_b")) | (paths.extension("file_a") != paths.extension("file_b"))
    return both.where(apart)


def least_support(commits: int) -> int:
    return 2 if commits < 50 else 3 if commits < 200 else 5


def contracts(commit_files: DataFrame, confidence: float = 0.7, most: int | None = 50, bulk: int = 20, least_commits: int = 10, source: str | None = SOURCE) -> DataFrame:
    """(file_a, file_b, occurrences, confidence): pairs with enough support whose Jaccard similarity reaches
    ``confidence``, the ``most`` best (None: all). With fewer than ``least_commits`` commits there are none."""
    commits = cut(sets(commit_files), "commits")  # read three times: for their number, for those of each file, and for pairs
    total = commits.agg(F.count("hash").alias("commits"))
    own = commits.select("hash", F.filter("files", lambda x: x.rlike(source)).alias("files")) if source else commits
    support = F.when(F.col("commits") < 50, 2).when(F.col("commits") < 200, 3).otherwise(5)
    n = _paired(own, bulk).groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("occurrences"))
    n = n.crossJoin(F.broadcast(total)).where((F.col("occurrences") >= support) & (F.col("commits") >= least_commits)).drop("commits")
    counts = commits.select(F.explode("files").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("commits"))
    n = n.join(counts.select(F.col("path").alias("file_a"), F.col("commits").alias("ca")), "file_a").join(counts.select(F.col("path").alias("file_b"), F.col("commits").alias("cb")), "file_b")
    out = n.select("file_a", "file_b", "occurrences", (F.col("occurrences") / (F.col("ca") + F.col("cb") - F.col("occurrences"))).alias("confidence")).where(F.col("confidence") >= confidence)
    return out if most is None else out.orderBy(F.desc("confidence"), "file_a", "file_b").limit(most)


def with_ids(found: DataFrame, prefix: str = "contract") -> DataFrame:
    """Ids ``contract-NNN`` by confidence; for a table already limited to its top."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy(F.desc("confidence"), "file_a", "file_b"))
    return found.withColumn("id", F.concat(F.lit(prefix + "-"), F.lpad(n.cast("string"), 3, "0")))


def change_frequency(commit_files: DataFrame, members: DataFrame) -> DataFrame:
    """(module, changes, frequency): changes of its files for each commit."""
    total = commit_files.agg(F.greatest(F.countDistinct("hash"), F.lit(1)).alias("commits"))
    per = members.join(file_counts(commit_files), "path", "left").groupBy("module").agg(F.coalesce(F.sum("commits"), F.lit(0)).alias("changes"))
    return per.crossJoin(F.broadcast(total)).select("module", "changes", (F.col("changes") / F.col("commits")).alias("frequency"))


def removed_imports(diff_lines: DataFrame, most_commits: int = 100, most: int = 20) -> DataFrame:
    """(hash, message) of commits that say they remove or restructure and whose diff takes out an import, the first
    ``most`` by ``ord`` among the first ``most_commits``."""
    commits = diff_lines.groupBy("hash", "message").agg(F.min("ord").alias("ord")).orderBy("ord").limit(most_commits)
    said = commits.where(F.col("message").rlike("(?i)decouple|delet|extract|refactor|remov|split"))
    gone = diff_lines.where(F.col("line").rlike(r"^-\s*(require|use|from|import)") & ~F.col("line").startswith("---")).select("hash").distinct()
    return said.join(gone, "hash", "left_semi").orderBy("ord").limit(most).select("hash", "message", "ord")
