"""Known architectures, told from the names of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators.signals import SCHEMA, signal

#: pattern → (layer → (level, keywords)); the position of a pattern breaks ties of confidence.
LAYERS: dict[str, dict[str, tuple[int, str]]] = {
    "clean-architecture": {
        "domain": (0, "core domain entities models"),
        "application": (1, "application interactors services use-cases usecases"),
        "infrastructure": (2, "adapters database db infra infrastructure repositories"),
        "interface": (2, "api controllers handlers interfaces presentation routes"),
    },
    "mvc": {"model": (0, "entities model models schemas"), "controller": (1, "controller controllers handlers routes"), "view": (2, "components pages templates view views")},
    "hexagonal": {"core": (0, "app core domain"), "ports": (1, "interfaces port ports"), "adapters": (2, "adapter adapters driven driving")},
    "feature-based": {},
    "layered": {"data": (0, "data database db repositories repository store stores"), "service": (1, "business logic service services"), "ui": (2, "components frontend pages ui views")},
}
#: pattern → pairs of layers that must not depend on one another, and the share of the confidence that is the signal's strength.
FORBIDDEN = {"clean-architecture": ((("domain", "infrastructure"), ("domain", "interface")), 0.9), "mvc": ((("view", "model"),), 0.7), "hexagonal": ((("core", "adapters"),), 0.85)}


def keywords(spark: SparkSession) -> DataFrame:
    """(pattern, layer, level, keyword): a fixed table of a hundred rows."""
    return spark.createDataFrame([(p, layer, level, w) for p, ls in LAYERS.items() for layer, (level, words) in ls.items() for w in words.split()], "pattern string, layer string, level int, keyword string")


def layer_members(modules: DataFrame) -> DataFrame:
    """(pattern, layer, level, id, name): modules whose name contains a keyword of the layer."""
    words = F.broadcast(keywords(modules.sparkSession))
    return modules.select("id", "name", F.lower("name").alias("low")).join(words, F.col("low").contains(F.col("keyword"))).select("pattern", "layer", "level", "id", "name").distinct()


def confidences(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """(pattern, ord, confidence) of the patterns that the modules fit."""
    order = F.create_map(*[F.lit(x) for i, p in enumerate(LAYERS) for x in (p, i)])
    size = F.create_map(*[F.lit(x) for p, ls in LAYERS.items() for x in (p, len(ls))])
    hit = layer_members(modules).groupBy("pattern").agg(F.countDistinct("layer").alias("n"), F.max((F.col("layer") == "ports").cast("int")).alias("ports"))
    fit = hit.where("n >= 2 and (pattern <> 'hexagonal' or ports = 1)")
    named = fit.select("pattern", order[F.col("pattern")].alias("ord"), (F.col("n") / size[F.col("pattern")] * F.when(F.col("pattern") == "layered", 0.8).otherwise(1.0)).alias("confidence"))
    loose = modules.agg(F.count(F.lit(1)).alias("m")).crossJoin(deps.agg(F.count(F.lit(1)).alias("d"))).where("m >= 3")
    share = F.col("d") / F.col("m") / (F.col("m") - 1)
    feature = loose.where((share <= 0.3) & (1 - share >= 0.5)).select(F.lit("feature-based").alias("pattern"), F.lit(list(LAYERS).index("feature-based")).alias("ord"), (1 - share).alias("confidence"))
    return named.union(feature)


def best(found: DataFrame) -> DataFrame:
    """The pattern of greatest confidence, the earlier of equals; no row without a pattern."""
    return found.orderBy(F.desc("confidence"), "ord").limit(1)


def pattern_signals(modules: DataFrame, deps: DataFrame, chosen: tuple[str, float] | None) -> DataFrame:
    """Signals of the chosen pattern (name, confidence)."""
    spark = modules.sparkSession
    if chosen is None:
        return spark.createDataFrame([], SCHEMA)
    name, confidence = chosen
    if name == "feature-based":
        rows = modules.agg(F.array_sort(F.collect_list("id")).alias("scope")).withColumn("first", F.element_at("scope", 1)).withColumn("pattern", F.lit(name))
        out = signal(rows, 100, "arch-pattern-match", ["first"], F.lit(confidence * 0.5), F.lit("modules stand mostly alone, as in a feature-based layout"), detectedPattern="pattern")
        scope = modules.agg(F.array_sort(F.collect_list("id")).alias("all"))
        return out.crossJoin(scope).select("seq", "kind", F.col("all").alias("scope"), "strength", "description", "ctx")
    pairs, share = FORBIDDEN.get(name, ((), 0.0))
    members = layer_members(modules).where(F.col("pattern") == name)
    out = spark.createDataFrame([], SCHEMA)
    for i, (a, b) in enumerate(pairs):
        x, y = members.where(F.col("layer") == a).select(F.col("id").alias("a"), F.col("name").alias("name_a")), members.where(F.col("layer") == b).select(F.col("id").alias("b"), F.col("name").alias("name_b"))
        rows = x.crossJoin(y).withColumn("pattern", F.lit(name)).withColumn("rule", F.lit(f"{a} must not use {b}"))
        out = out.union(signal(rows, 100 + i, "arch-pattern-match", ["a", "b"], F.lit(confidence * share), F.format_string(f"{name}: %s ({a}) must not use %s ({b})", "name_a", "name_b"), detectedPattern="pattern", expectedRule="rule"))
    return out


def detect(modules: DataFrame, deps: DataFrame) -> tuple[tuple[str, float] | None, DataFrame]:
    """The best pattern, one small row, and its signals."""
    row = best(confidences(modules, deps)).first()
    chosen = (row.pattern, row.confidence) if row else None
    return chosen, pattern_signals(modules, deps, chosen)
