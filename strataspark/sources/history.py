"""Version history: a thin adapter around the ``git`` program, and its text as tables."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.plans.tables import spread


def _git(root: str, *args: str) -> str | None:
    try:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    except OSError:
        return None
    return got.stdout if got.returncode == 0 else None


def prefix_of(root: str) -> str:
    """Path of ``root`` within its repository, with a slash at its end, or empty."""
    return (_git(root, "rev-parse", "--show-prefix") or "").strip()


def log_lines(spark: SparkSession, root: str, most: int = 1000) -> DataFrame | None:
    """(ord, line) of the log with changed files; None outside a repository."""
    text = _git(root, "log", f"--max-count={int(most)}", "--numstat", "--format=%H")
    return None if text is None else spark.createDataFrame(list(enumerate(text.splitlines())), "ord long, line string")


#: Lines of a log that are put in order together.
STRETCH = 100_000


def parse_log(lines: DataFrame, prefix: str = "", by: str | None = None) -> DataFrame:
    """``commit_files(hash, path)``: a line of 40 hex digits begins a commit, ``added TAB removed TAB path`` names a
    file; renames and paths outside ``prefix`` are dropped, and the prefix is taken off.

    ``by``: a column, such as the log's name, within which lines are in order; a log is read in one piece then, logs lie in as many partitions as
    their lines ask for, and each file of a commit has one row of the log's, with the column. Without it the one log is
    read in stretches of ``STRETCH`` lines, and a stretch that begins within a commit takes it from those before, of which one row each is looked at.
    """
    s = F.trim("line")
    rows = lines.select("*", F.when(s.rlike("^[0-9a-f]{40}$"), s).alias("h"), F.regexp_extract(s, r"^[0-9]+\t[0-9]+\t(\S.*)$", 1).alias("p"))
    if by:
        rows = spread(rows.select(by, "ord", "h", "p").where("h is not null or p <> ''"), lines.count(), by)
    else:
        rows = rows.withColumn("__part", F.floor(F.col("ord") / STRETCH))
    local = Window.partitionBy(by or "__part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hash", F.last("h", ignorenulls=True).over(local))
    if not by:
        last = rows.groupBy("__part").agg(F.max_by("h", F.when(F.col("h").isNotNull(), F.col("ord"))).alias("h"))
        before = last.select("__part", F.last("h", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
        rows = rows.join(before, "__part").withColumn("hash", F.coalesce("hash", "__before"))
    rows = rows.where("p <> '' and hash is not null and not contains(p, '=>')")
    path = F.regexp_replace("p", r"\\", "/")
    if prefix:
        rows = rows.where(path.startswith(prefix))
        path = F.substring(path, len(prefix) + 1, 1 << 30)
    rows = rows.select(*[by] * bool(by), "hash", path.alias("path"))
    return rows.distinct() if by else rows


def commit_files(spark: SparkSession, root: str, most: int = 1000) -> DataFrame | None:
    lines = log_lines(spark, root, most)
    return None if lines is None else parse_log(lines, prefix_of(root))


def diff_lines(spark: SparkSession, root: str, most: int = 500, commits: int = 100) -> DataFrame | None:
    """(ord, hash, message, line) of commits that touched imports, the newest first."""
    log = _git(root, "log", f"--max-count={int(most)}", "--all", "--diff-filter=M", "--format=%H %s", "-S", "import")
    if log is None:
        return None
    rows = []
    for i, entry in enumerate(log.splitlines()[:commits]):
        h, _, message = entry.partition(" ")
        rows += [(i, h, message, line) for line in (_git(root, "diff", f"{h}~1", h, "--unified=0") or "").splitlines()]
    return spark.createDataFrame(rows, "ord int, hash string, message string, line string")


def changed_paths(root: str, last: str) -> list[str] | None:
    """Paths changed since a commit, staged or untracked; None asks for a full scan."""
    parts = [_git(root, "diff", "--name-only", last, "HEAD"), _git(root, "diff", "--cached", "--name-only"), _git(root, "ls-files", "--others", "--exclude-standard")]
    return None if any(p is None for p in parts) else sorted({x for p in parts for x in p.splitlines() if x})


def head(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def hook(root: str, command: str, remove: bool = False) -> bool:
    """Install or remove a fenced block in the pre-commit hook; tells whether it changed."""
    where = _git(root, "rev-parse", "--git-path", "hooks/pre-commit")
    if where is None:
        return False
    from strataspark.sources.sinks import fenced

    path = Path(root) / where.strip()
    before = path.read_text() if path.exists() else "#!/bin/sh\n"
    after = fenced(before, None if remove else command, "# strata begin", "# strata end")
    if after == before:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(after)
    path.chmod(0o755)
    return True
