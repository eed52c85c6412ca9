"""Modules: files grouped by directory, with their public API and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions import paths
from strataspark.operators.resolve import package_name


def module_id(path: Column | str, roots: tuple[str, ...]) -> Column:
    """``root/next`` for the earliest segment that is a root and has two more behind it, else the directory.

    What stands before the root is dropped, so equal roots in different places make one module.
    """
    path = paths.col(path)
    parts = F.split(path, "/")
    at = F.array_min(F.filter(F.array(*[F.array_position(parts, r) for r in roots]), lambda i: i > 0)) if roots else F.lit(None)
    named = F.array_join(F.slice(parts, at.cast("int"), F.lit(2)), "/")
    return F.when(at.isNotNull() & (F.size(parts) - at >= 2), named).otherwise(paths.dirname(path))


def module_files(files: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    return files.select(module_id("path", roots).alias("module"), "path", "language")


def primary_language(members: DataFrame) -> DataFrame:
    """(module, language): the most frequent, of equals the one of the least path."""
    counts = members.groupBy("module", "language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("p"))
    return counts.groupBy("module").agg(F.min_by("language", F.struct((-F.col("n")).alias("n"), "p")).alias("language"))


def public_api(members: DataFrame, exports: DataFrame) -> DataFrame:
    """(module, path, ord, name, kind, line): exports of the barrel file, of all files where there is none."""
    barrel = F.col("path").rlike(r"(^|/)index\.[jt]sx?$") | (F.regexp_extract("path", r"^(.*)\.(ts|js)$", 1) == F.col("module"))
    entry = members.where(barrel).groupBy("module").agg(F.min("path").alias("barrel"))
    own = members.join(entry, "module", "left").where("barrel is null or barrel = path").select("module", "path")
    return own.join(exports, "path").select("module", "path", "ord", "name", "kind", "line")


def module_deps(members: DataFrame, edges: DataFrame, imports: DataFrame, resolve_absolute: bool = False) -> DataFrame:
    """(module, dep): other modules that its files import from.

    In parity mode only files with a relative import count; ``resolve_absolute`` counts all.
    """
    a, b = members.select(F.col("path").alias("src"), "module"), members.select(F.col("path").alias("dst"), F.col("module").alias("dep"))
    if not resolve_absolute:
        a = a.join(imports.where("is_relative").select(F.col("path").alias("src")).distinct(), "src", "left_semi")
    # what a module uses is far less than what its files do
    used = edges.select("src", "dst").join(a, "src").select("module", "dst").distinct()
    return used.join(b, "dst").where("module <> dep").select("module", "dep").distinct()


def external_deps(members: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, package) of every import that isn't relative, also those that resolve within the project."""
    return imports.where("not is_relative").select("path", package_name("source").alias("package")).join(members, "path").select("module", "package").distinct()


def modules(members: DataFrame, api: DataFrame, deps: DataFrame, ext: DataFrame) -> DataFrame:
    """One row a module: id, name, language, files, n_exports, internal_deps, external_deps; ordered by id where it is written."""
    base = members.groupBy("module").agg(F.array_sort(F.collect_list("path")).alias("files"))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    names = lambda df, c, out: df.groupBy("module").agg(F.array_sort(F.collect_set(c)).alias(out))
    out = base.join(primary_language(members), "module").join(api.groupBy("module").agg(F.count(F.lit(1)).alias("n_exports")), "module", "left")
    out = out.join(names(deps, "dep", "internal_deps"), "module", "left").join(names(ext, "package", "external_deps"), "module", "left")
    return out.select(F.col("module").alias("id"), F.substring_index("module", "/", -1).alias("name"), "language", "files", F.coalesce("n_exports", F.lit(0)).cast("int").alias("n_exports"), empty(F.col("internal_deps")).alias("internal_deps"), empty(F.col("external_deps")).alias("external_deps"))


def module_layers(mods: DataFrame, deps: DataFrame) -> DataFrame:
    from strataspark.operators.graph import layers

    found = layers(mods.select(F.col("id").alias("node")), deps.select(F.col("module").alias("src"), F.col("dep").alias("dst")))
    return found.select("level", F.concat(F.lit("layer-"), "level").alias("layer"), F.col("node").alias("module"))
