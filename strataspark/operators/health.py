"""Health of the whole and of each module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.operators.risk import rounded

WEIGHTS = {"boundary": 1.5, "layer": 1.3, "co-change": 1.0, "ownership": 0.8, "naming": 0.5}


def _weight(category: str = "category"):
    return F.coalesce(F.create_map(*[F.lit(x) for p in sorted(WEIGHTS.items()) for x in p])[F.col(category)], F.lit(1.0))


def _clamped(x):
    return F.greatest(F.lit(0), F.least(F.lit(100), rounded(x))).cast("int")


def rule_sizes(rules: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, size): files of the first entry of a rule's scope that is a module, else 1."""
    entries = rules.select("id", F.posexplode("scope").alias("i", "m"))
    found = entries.join(modules.select(F.col("id").alias("m"), F.size("files").alias("n")), "m").groupBy("id").agg(F.min_by("n", "i").alias("size"))
    return rules.select("id").join(found, "id", "left").select("id", F.coalesce("size", F.lit(1)).alias("size"))


def health(rules: DataFrame, modules: DataFrame, insights: DataFrame) -> DataFrame:
    """One row: overall, trend, and totals by tier."""
    average = modules.agg(F.greatest(F.coalesce(F.avg(F.size("files")), F.lit(1.0)), F.lit(1.0)).alias("average"))
    violated = F.col("evidence.recent_violations") > 0
    rows = rules.join(rule_sizes(rules, modules), "id").crossJoin(F.broadcast(average))
    points = F.when(F.col("tier") == "rule", 15).when(F.col("tier") == "convention", 5).otherwise(0)
    lost = F.when(violated, points * _weight() * F.greatest(F.lit(0.5), F.col("size") / F.col("average"))).otherwise(0.0)
    n = lambda c: F.count(F.when(c, 1))
    trend, tier = F.col("trend"), F.col("tier")
    r = rows.agg(
        F.coalesce(F.sum(lost), F.lit(0.0)).alias("lost"), n(trend == "weakening").alias("weakening"), n(trend == "broken").alias("broken"), n(trend == "strengthening").alias("strengthening"),
        F.count(F.lit(1)).alias("rules"), n(tier == "observation").alias("observations"), n(tier == "convention").alias("conventions"), n(tier == "rule").alias("strong"),
        n((tier == "convention") & violated).alias("convention_violations"), n((tier == "rule") & violated).alias("rule_violations"),
    )
    m = F.col("metric")
    i = insights.agg((n(m == "bottleneck") * 2 + n(m == "circular-dependency") * 5 + F.when(n(m == "concentration-risk") > 0, 10).otherwise(0) + n(m == "untested-high-risk") + n(m.isin("god-module-size", "god-module-exports"))).alias("penalty"))
    both = r.crossJoin(i)
    overall = _clamped(F.lit(100.0) - F.col("lost") - F.col("weakening") * 3 - F.col("broken") * 8 - F.col("penalty"))
    direction = F.when(F.col("broken") > 0, "broken").when(F.col("weakening") > F.col("rules") * 0.2, "weakening").when(F.col("strengthening") > F.col("rules") * 0.2, "strengthening").otherwise("stable")
    return both.select(overall.alias("overall"), direction.alias("trend"), "observations", "conventions", "convention_violations", F.col("strong").alias("rules"), "rule_violations")


def module_scores(rules: DataFrame, modules: DataFrame, insights: DataFrame) -> DataFrame:
    """(module, score, violations)."""
    bad = rules.where("evidence.recent_violations > 0").select("id", F.explode(F.array_distinct("scope")).alias("m"), (F.when(F.col("tier") == "rule", 15).when(F.col("tier") == "convention", 5).otherwise(0) * _weight()).alias("points"))
    ids = modules.select(F.col("id").alias("module"))
    # a rule whose scope names the module as well as '*' counts once
    hit = ids.join(bad.where("m <> '*'"), F.col("module") == F.col("m")).select("module", "id", "points").union(ids.crossJoin(bad.where("m = '*'").select("id", "points"))).distinct()
    v = hit.groupBy("module").agg(F.sum("points").alias("lost"), F.count(F.lit(1)).alias("broken"))
    files = modules.select(F.col("id").alias("module"), F.explode("files").alias("file"))
    own = insights.where("module is not null").select("module", "id", "metric", "severity")
    theirs = insights.where("file is not null").select("file", "id", "metric", "severity").join(files, "file").select("module", "id", "metric", "severity")
    i = own.union(theirs).distinct().groupBy("module").agg(F.count(F.when(F.col("severity") == "critical", 1)).alias("critical"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warning"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = ids.join(v, "module", "left").join(i, "module", "left")
    return out.select("module", _clamped(F.lit(100.0) - zero("lost") - zero("critical") * 3 - zero("warning")).alias("score"), (zero("broken") + zero("critical")).cast("int").alias("violations"))
