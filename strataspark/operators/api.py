"""Queries over the tables of a scan: those of the tool server, the command line and the editor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.plans.tables import first


def get_modules(modules: DataFrame, exports: DataFrame) -> DataFrame:
    """(id, name, language, file_count, public_api, internal_deps, external_deps): the API as ``name (kind)``."""
    api = exports.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "ord", "name", "kind"))), lambda e: F.format_string("%s (%s)", e["name"], e["kind"])).alias("public_api"))
    out = modules.join(api.withColumnRenamed("module", "id"), "id", "left")
    return out.select("id", "name", "language", F.size("files").alias("file_count"), F.coalesce("public_api", F.array().cast("array<string>")).alias("public_api"), "internal_deps", "external_deps")


def get_module(modules: DataFrame, wanted: str) -> DataFrame:
    """By id or name; KeyError names the modules there are."""
    out = modules.where((F.col("id") == F.lit(wanted)) | (F.col("name") == F.lit(wanted)))
    if out.isEmpty():
        raise KeyError(f"no module {wanted!r}; there are: " + ", ".join(r.id for r in modules.select("id").orderBy("id").collect()))
    return out


def get_dependencies(edges: DataFrame, module: str | None = None) -> DataFrame:
    """Edges that begin or end with a prefix."""
    out = edges if module is None else edges.where(F.col("src").startswith(F.lit(module)) | F.col("dst").startswith(F.lit(module)))
    return out.select("src", "dst", "type", "weight")


def get_rules(rules: DataFrame, tier: str | None = None, category: str | None = None, min_confidence: float | None = None) -> DataFrame:
    for name, value in (("tier", tier), ("category", category)):
        if value is not None:
            rules = rules.where(F.col(name) == F.lit(value))
    if min_confidence is not None:
        rules = rules.where(F.col("confidence") >= min_confidence)
    return rules.orderBy(F.desc("confidence"), "id")


def check_impact(file: str, members: DataFrame, edges: DataFrame, contracts: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Owner module, direct dependents, contracts that name the file (or are named in it), and its chain."""
    f = F.lit(file)
    chain = links.where(F.col("file") == f).orderBy("resource").limit(1).select("resource")
    named = lambda c: F.col(c).contains(f) | f.contains(F.col(c))
    return {
        "module": members.where(F.col("path") == f).select("module"),
        "dependents": edges.where(F.col("dst") == f).select("src", "type", "weight"),
        "contracts": contracts.where(named("file_a") | named("file_b")),
        "chain": links.join(chain, "resource", "left_semi"),
    }


def impacted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module, file, dependents): the batch form of :func:`check_impact`, for every file at once."""
    n = edges.groupBy(F.col("dst").alias("path")).agg(F.countDistinct("src").alias("dependents"))
    return members.join(n, "path", "left").select("module", F.col("path").alias("file"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


def depended_on_by(edges: DataFrame, members: DataFrame, module: str) -> DataFrame:
    """(parent): first two segments of files outside a module that import from it."""
    own = members.where(F.col("module") == F.lit(module)).select(F.col("path").alias("dst"))
    return edges.join(own, "dst", "left_semi").where(~F.col("src").startswith(F.lit(module + "/"))).select(F.substring_index("src", "/", 2).alias("parent")).distinct()


def top_per_tier(rules: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most confident rules of each tier."""
    return rules.withColumn("place", first(F.struct((-F.col("confidence")).alias("c"), "id"), "tier")).where(F.col("place") <= k)


def violations(rules: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Rules the gate looks at: broken rules and conventions, and those that weaken. Ready for ``passes``."""
    own = rules.where(F.col("confidence") >= min_confidence)
    kind = F.when((F.col("tier") == "rule") & (F.col("evidence.recent_violations") > 0), "rule").when((F.col("tier") == "convention") & (F.col("evidence.recent_violations") > 0), "convention").when(F.col("trend").isin("weakening", "broken"), "drift")
    return own.withColumn("finding", kind).where("finding is not null")


def passes(rules: DataFrame, min_confidence: float = 0.8) -> bool:
    """The gate: no confident rule is violated."""
    return violations(rules, min_confidence).where("finding = 'rule'").isEmpty()


def defining_module(members: DataFrame, exports: DataFrame, file: str, symbol: str) -> DataFrame:
    """(module): where a symbol that ``file`` uses is defined, other than its own module; the least of several."""
    own = members.where(F.col("path") == F.lit(file)).select("module")
    return exports.where(F.col("name") == F.lit(symbol)).select("module").join(own, "module", "left_anti").agg(F.min("module").alias("module")).where("module is not null")
