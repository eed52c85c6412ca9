"""The catalogue of source files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.config import EXTENSIONS, Config
from strataspark.functions import paths
from strataspark.plans.tables import cut

FILES = "path string, language string, ext string, is_support boolean, content string"


def language_of(ext: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(EXTENSIONS.items()) for x in pair])[ext], F.lit("unknown"))


def ignore_regex(pattern: str) -> str | None:
    """Regular expression of one line of an ignore file, without its leading ``!``; None for blanks and comments.

    Supported: anchoring by a slash, ``*``, ``?``, ``**``, classes, and a trailing slash for directories.
    """
    p = pattern.strip().lstrip("!")
    if not p or p.startswith("#"):
        return None
    directory, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    out = []
    for part in re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", p):
        out.append({"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part.startswith("[") else re.escape(part)))
    return ("^" if anchored else "(?:^|/)") + "".join(out) + ("/" if directory else "(?:/|$)")


def is_ignored(path: Column | str, patterns: list[str] | tuple[str, ...]) -> Column:
    """Whether an ignore list covers a path; the last pattern that matches decides, ``!`` takes back."""
    path = paths.col(path)
    out = F.lit(False)
    for line in patterns:
        rx = ignore_regex(line)
        if rx:
            out = F.when(path.rlike(rx), F.lit(not line.strip().startswith("!"))).otherwise(out)
    return out


def catalogue(raw: DataFrame, config: Config = Config(), ignored: tuple[str, ...] = ()) -> DataFrame:
    """``files`` of raw (path, content): known languages only, without hidden, excluded and ignored paths."""
    ext = F.lower(paths.extension("path"))
    rows = raw.select("path", language_of(ext).alias("language"), ext.alias("ext"), paths.is_support("path").alias("is_support"), "content")
    known = rows.where(F.col("language").isin(*config.languages) & ~F.col("path").rlike(r"(^|/)\."))
    return known.where(~is_ignored("path", (*ignored, *config.exclude)) & F.col("content").isNotNull())


def listing(root: str, config: Config = Config()) -> list[str]:
    """Paths of source files below a mounted folder, relative to it. Excluded directories aren't entered.

    Spark's own listing leaves out names that begin with an underscore, such as ``__init__.py``.
    """
    names, skip = _wanted(config)
    where, out = local(root), []
    for folder, dirs, files in os.walk(where):
        dirs[:] = sorted(d for d in dirs if d not in skip and d[0] != ".")
        out += [os.path.relpath(os.path.join(folder, f), where) for f in files if f.lower().endswith(names) and f[0] != "."]
    return sorted(out)


def _wanted(config: Config) -> tuple[tuple[str, ...], set[str]]:
    """Extensions of the languages, and names of directories that aren't entered."""
    return tuple(e for e, lang in EXTENSIONS.items() if lang in config.languages), {p for p in config.exclude if "/" not in p and "*" not in p}


def walked(spark: SparkSession, root: str, config: Config = Config(), directories_per_task: int = 64) -> DataFrame:
    """(path) of the source files below any folder, as :func:`listing` gives them: executors list the directories of a level side by side, and no
    list of paths passes through the driver."""
    names, skip = _wanted(config)

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
                rows = [(f"{folder}/{f.base_name}".lstrip("/"), f.type == fs.FileType.Directory) for f in found if f.base_name[0] != "."]
                rows = [(p, d) for p, d in rows if (p.rsplit("/", 1)[-1] not in skip if d else p.lower().endswith(names))]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.bool_())], names=["path", "is_directory"])

    level, out = spark.createDataFrame([("",)], "path string"), None
    while True:
        now = cut(level.mapInArrow(children, "path string, is_directory boolean"), "listing")
        own = now.where("not is_directory").select("path")
        out = own if out is None else out.union(own)
        n = now.where("is_directory").count()
        if not n:
            return out
        level = now.where("is_directory").select("path").repartition(-(-n // directories_per_task), "path")


def local(path: str) -> str | None:
    url = urlparse(path)
    return url.path if url.scheme == "file" else path if not url.scheme else None


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; object stores go by Hadoop's names too."""
    where = local(root)
    if where is not None:
        return fs.LocalFileSystem(), where.rstrip("/")
    scheme, _, rest = root.partition("://")
    try:
        system, base = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest}")
    except pa.ArrowInvalid:  # Arrow has no client of its own
        url = urlparse(root)
        system, base = fs.HadoopFileSystem(f"{url.scheme}://{url.netloc}", 0), url.path
    return system, base.rstrip("/")


def _contents(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    system, base = opened(root)
    for b in batches:
        for s in range(0, b.num_rows, 64):
            names, texts = b.column(0).slice(s, 64).to_pylist(), []
            for name in names:
                try:
                    with system.open_input_stream(f"{base}/{name}") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except OSError:  # gone or unreadable: null, dropped later
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])


def discover(spark: SparkSession, root: str, config: Config = Config(), names: list[str] | None = None, files_per_task: int = 512) -> DataFrame:
    """Source files below ``root``, their contents read by the executors; unreadable files are dropped. Names of a mounted folder are listed on the
    driver (or given), others by :func:`walked`."""
    if names is None and local(root) is None:
        paths_ = walked(spark, root, config)
        paths_ = paths_.repartition(max(1, -(-paths_.count() // files_per_task)), "path")
    else:
        names = listing(root, config) if names is None else names
        paths_ = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, -(-len(names) // files_per_task)), "path")
    raw = paths_.mapInArrow(lambda it: _contents(it, root), "path string, content string")
    where = local(root)
    listed = Path(where) / ".gitignore" if where is not None else None
    return catalogue(raw, config, tuple(listed.read_text().splitlines()) if listed and listed.exists() else ())
