"""Insights: sixteen detectors over metrics of files and modules, then the ones that say more replace those that say less.

``insights(severity, metric, id, file, module, description, action, data, detector, ord)``: ids are ``kind-key`` with
the file, module or resource in place of a running number, so they don't depend on order. ``ord`` orders the rows of a
detector.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.config import Thresholds
from strataspark.functions import paths
from strataspark.operators import graph
from strataspark.operators.risk import rounded

COLUMNS = ("severity", "id", "file", "module", "metric", "description", "action", "data", "detector", "ord")


def _rows(df: DataFrame, detector: int, metric: str, severity: Column | str, key: str, text: Column, advice: str, data: list[str], file: str | None = None, module: str | None = None, order: Column | None = None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    null = F.lit(None).cast("string")
    return df.select(
        severity.alias("severity"), F.concat(F.lit(metric + ":"), F.col(key)).alias("id"), (F.col(file) if file else null).alias("file"), (F.col(module) if module else null).alias("module"),
        F.lit(metric).alias("metric"), text.alias("description"), F.lit(advice).alias("action"), F.to_json(F.struct(*data)).alias("data"), F.lit(detector).alias("detector"), (order if order is not None else F.lit(0.0)).cast("double").alias("ord"),
    )


def percent(part: Column | str, whole: Column | str) -> Column:
    return rounded(paths.col(part) / paths.col(whole) * 100).cast("int")


def with_total(df: DataFrame, files: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(files.agg(F.count(F.lit(1)).alias("total_files"))))


def by_score() -> Column:
    return -F.col("score")


def single_points(risks: DataFrame, files: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = with_total(risks.where(F.col("fan_in") >= t.spof[0]), files).withColumn("pct", percent("transitive_impact", "total_files"))
    severity = F.when(F.col("fan_in") >= t.spof[2], "critical").when(F.col("fan_in") >= t.spof[1], "warning").otherwise("info")
    return _rows(rows, 1, "single-point-of-failure", severity, "file", F.format_string("%s carries %d files directly and %d in all, %d%% of the files.", "file", "fan_in", "transitive_impact", "pct"), "Change it with care, or split it.", ["fan_in", "transitive_impact", "pct"], "file", order=by_score())


def high_fan_out(edges: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = graph.fan_out(edges).withColumnRenamed("node", "file").where((F.col("fan_out") >= t.fan_out[0]) & ~paths.is_test("file"))
    return _rows(rows, 2, "high-fan-out", F.when(F.col("fan_out") >= t.fan_out[1], "warning").otherwise("info"), "file", F.format_string("%s uses %d other files.", "file", "fan_out"), "See whether it needs them all.", ["fan_out"], "file")


def god_modules(modules: DataFrame, files: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = modules.where(~paths.is_migration("id")).withColumn("n_files", F.size("files"))
    rows = with_total(rows, files).crossJoin(F.broadcast(modules.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_modules")))).withColumn("average", F.col("total_files") / F.col("n_modules")).withColumn("mean", rounded(F.col("average")))
    size = _rows(rows.where((F.col("n_files") > F.col("average") * t.god_times) & (F.col("n_files") >= t.god_files)), 3, "god-module-size", "warning", "id", F.format_string("%s holds %d files where modules have %d on average.", "id", "n_files", "mean"), "Split it by topic.", ["n_files", "mean"], module="id")
    wide = _rows(rows.where(F.col("n_exports") >= t.god_exports[0]), 3, "god-module-exports", F.when(F.col("n_exports") >= t.god_exports[1], "warning").otherwise("info"), "id", F.format_string("%s exports %d names.", "id", "n_exports"), "See which of them others need.", ["n_exports"], module="id")
    return size.union(wide)


def long_chains(critical: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = critical.where(F.col("length") >= t.long_chain[0]).withColumn("key", F.concat_ws(">", "leaf_file", "root_file"))
    return _rows(rows, 4, "long-dependency-chain", F.when(F.col("length") >= t.long_chain[1], "warning").otherwise("info"), "key", F.format_string("%d files in a row lead from %s to %s.", "length", "leaf_file", "root_file"), "Keep the far end compatible, or break the row with an interface.", ["length", "root_file", "leaf_file"], "root_file", order=-F.col("length"))


def bottlenecks(risks: DataFrame, files: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = with_total(risks.where((F.col("fan_in") >= t.bottleneck_fan_in) & F.col("on_critical_path")).orderBy(F.desc("score"), "file").limit(t.bottleneck_most), files).withColumn("pct", percent("transitive_impact", "total_files"))
    return _rows(rows, 5, "bottleneck", "critical", "file", F.format_string("%s carries %d files and lies on a longest chain; %d%% of the files feel its changes.", "file", "fan_in", "pct"), "Settle its interface and test it first.", ["fan_in", "transitive_impact", "pct"], "file", order=by_score())


def untested(risks: DataFrame) -> DataFrame:
    rows = risks.where(F.col("risk").isin("critical", "high") & ~F.col("has_tests"))
    return _rows(rows, 6, "untested-high-risk", "warning", "file", F.format_string("%s is of %s risk (%d direct, %d in all) and has no tests.", "file", "risk", "fan_in", "transitive_impact"), "Write tests for it.", ["risk", "fan_in", "transitive_impact"], "file", order=by_score())


def circular(cycles: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = cycles.orderBy("component").limit(t.cycles_most).withColumn("way", F.array_join("files", " > "))
    return _rows(rows, 7, "circular-dependency", F.when(F.col("length") >= 3, "critical").otherwise("warning"), "component", F.format_string("%d files depend on one another in a circle: %s", "length", "way"), "Move what they share elsewhere, or turn one dependency round.", ["length", "files"], "component")


def dead_modules(risks: DataFrame, edges: DataFrame, single: bool = False) -> DataFrame:
    """``single`` as in :func:`graph.fan_out`."""
    rows = risks.where((F.col("fan_in") == 0) & ~paths.is_entry_point("file") & ~paths.is_test("file") & ~paths.is_script("file")).join(graph.fan_out(edges, single).withColumnRenamed("node", "file"), "file", "left").fillna(0, ["fan_out"]).where("fan_out <= 1")
    return _rows(rows, 8, "dead-module", "info", "file", F.format_string("Nothing uses %s, and it uses %d file(s).", "file", "fan_out"), "Look for uses that imports don't show; else remove it.", ["fan_out"], "file", order=by_score())


def hubs(risks: DataFrame, edges: DataFrame, t: Thresholds = Thresholds(), single: bool = False) -> DataFrame:
    rows = risks.where(F.col("fan_in") >= t.hub[0]).join(graph.fan_out(edges, single).withColumnRenamed("node", "file").where(F.col("fan_out") >= t.hub[1]), "file")
    return _rows(rows, 9, "hub-file", "warning", "file", F.format_string("%s carries %d files and itself rests on %d.", "file", "fan_in", "fan_out"), "Separate what others use from what uses others.", ["fan_in", "fan_out"], "file", order=by_score())


def unstable_cores(fan: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``fan`` as from :func:`signals.module_fan`."""
    rows = fan.where((F.col("fan_in") >= t.core_fan_in) & (F.col("instability") > t.core_instability)).withColumn("inst", F.format_string("%.2f", "instability"))
    return _rows(rows, 10, "unstable-core", "warning", "id", F.format_string("%s carries %d modules, yet rests on %d (instability %s).", "id", "fan_in", "fan_out", "inst"), "Let it depend on less.", ["fan_in", "fan_out", "inst"], module="id")


def incomplete_chains(chains: DataFrame) -> DataFrame:
    """``chains`` as from :func:`chains.chains`."""
    has = lambda r: F.array_contains("roles", r)
    lacks = F.array_compact(F.array(
        F.when(has("model") & ~has("schema"), F.struct(F.lit("info").alias("severity"), F.lit("schema").alias("missing"))),
        F.when(has("api") & F.col("is_cross_stack") & ~has("hook") & ~has("store") & ~has("page"), F.struct(F.lit("warning").alias("severity"), F.lit("consumer").alias("missing"))),
        F.when(has("model") & has("api") & ~has("service"), F.struct(F.lit("info").alias("severity"), F.lit("service").alias("missing"))),
    ))
    rows = chains.select("resource", "roles", F.explode(lacks).alias("l")).select("resource", "roles", "l.*").withColumn("key", F.concat_ws(":", "missing", "resource"))
    return _rows(rows, 11, "incomplete-chain", F.col("severity"), "key", F.format_string("The chain of %s has no %s.", "resource", "missing"), "Add it, or see who plays its part.", ["resource", "roles", "missing"])


def orphan_endpoints(risks: DataFrame, links: DataFrame) -> DataFrame:
    rows = risks.where((F.col("fan_in") == 0) & paths.is_api("file")).join(links.select("file").distinct(), "file", "left_anti")
    return _rows(rows, 12, "orphan-endpoint", "info", "file", F.format_string("No consumer of the endpoint %s is known.", "file"), "See whether it is used from outside.", ["fan_in"], "file", order=by_score())


def hotspots(risks: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = risks.where((F.col("change_frequency") > t.hotspot[0]) & (F.col("fan_in") >= t.hotspot[1]) & ~paths.is_config("file")).withColumn("pct", rounded(F.col("change_frequency") * 100).cast("int"))
    return _rows(rows, 13, "hotspot", F.when((F.col("change_frequency") > 0.3) & (F.col("fan_in") >= 10), "warning").otherwise("info"), "file", F.format_string("%s is in %d%% of commits and carries %d files.", "file", "pct", "fan_in"), "Settle its interface, and test what is used most.", ["pct", "fan_in"], "file", order=by_score())


def unlinked_contracts(contracts: DataFrame, edges: DataFrame, links: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Contracts between files without an edge and outside one chain: anti-joins on the pair in order."""
    keyed = contracts.where(F.col("confidence") >= t.hidden).withColumn("lo", F.least("file_a", "file_b")).withColumn("hi", F.greatest("file_a", "file_b"))
    e = edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    x, y = links.select("resource", F.col("file").alias("lo")), links.select("resource", F.col("file").alias("hi"))
    # pairs of one chain have ten roles at most, and only files of contracts are of interest
    c = x.join(y, "resource").where("lo < hi").select("lo", "hi").distinct()
    return keyed.join(e, ["lo", "hi"], "left_anti").join(c, ["lo", "hi"], "left_anti").drop("lo", "hi")


def hidden_coupling(contracts: DataFrame, edges: DataFrame, links: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = unlinked_contracts(contracts, edges, links, t).orderBy(F.desc("confidence"), "file_a", "file_b").limit(t.hidden_most).withColumn("pct", rounded(F.col("confidence") * 100).cast("int")).withColumn("key", F.concat_ws("|", "file_a", "file_b"))
    return _rows(rows, 14, "hidden-coupling", F.when(F.col("confidence") >= 0.9, "warning").otherwise("info"), "key", F.format_string("%s and %s change together %d%% of the time without an import between them.", "file_a", "file_b", "pct"), "Find what ties them.", ["file_a", "file_b", "pct", "occurrences"], order=-F.col("confidence"))


def over_exposed(modules: DataFrame, used: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    rows = modules.where(~paths.is_library("id") & (F.col("n_exports") >= t.exposed_least)).join(used, "id", "left").fillna(0, ["used"]).withColumn("unused", F.col("n_exports") - F.col("used"))
    rows = rows.where((F.col("unused") > F.col("n_exports") * 0.5) & (F.col("unused") >= t.exposed_least)).withColumn("pct", percent("unused", "n_exports"))
    return _rows(rows, 15, "over-exposed-api", F.when((F.col("unused") > F.col("n_exports") * 0.7) & (F.col("unused") >= 20), "warning").otherwise("info"), "id", F.format_string("%d of %d names that %s exports (%d%%) have no user.", "unused", "n_exports", "id", "pct"), "Make private what nobody uses.", ["n_exports", "used", "unused"], module="id")


def concentration(risks: DataFrame, files: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """At most one row: the three files with the most dependents hold half of all dependencies or more."""
    total = risks.agg(F.sum("fan_in").alias("total"))
    top = risks.orderBy(F.desc("fan_in"), F.desc("score"), "file").limit(3).agg(F.sum("fan_in").alias("top"), F.array_sort(F.collect_list("file")).alias("top3"))
    rows = with_total(top.crossJoin(total), files).where((F.col("total_files") >= t.concentration_files) & (F.col("total") > 0)).withColumn("share", F.col("top") / F.col("total")).where(F.col("share") >= t.concentration[0])
    rows = rows.withColumn("pct", rounded(F.col("share") * 100).cast("int")).withColumn("key", F.lit("0")).withColumn("names", F.array_join("top3", ", "))
    return _rows(rows, 16, "concentration-risk", F.when(F.col("share") > t.concentration[1], "critical").otherwise("warning"), "key", F.format_string("%d%% of all dependencies rest on %s.", "pct", "names"), "Spread what these files do.", ["pct", "top3", "top"])


def deduplicated(found: DataFrame) -> DataFrame:
    """A bottleneck or a hub replaces the single point of failure of its file, a hub also the high fan-out."""
    strong = found.where(F.col("metric").isin("bottleneck", "hub-file")).select("file", F.explode(F.when(F.col("metric") == "bottleneck", F.array(F.lit("single-point-of-failure"))).otherwise(F.array(F.lit("single-point-of-failure"), F.lit("high-fan-out")))).alias("metric")).where("file is not null").distinct()
    return found.join(strong, ["file", "metric"], "left_anti").select(*found.columns)


def severity_rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "critical", 0).when(F.col(c) == "warning", 1).otherwise(2)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(severity_rank(), "detector", "ord", "id")


def all_insights(risks: DataFrame, critical: DataFrame, modules: DataFrame, edges: DataFrame, cycles: DataFrame, chains: DataFrame, links: DataFrame, contracts: DataFrame | None, files: DataFrame, fan: DataFrame, used: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """All detectors; without history (``contracts`` None) there is no hidden coupling."""
    makers = [
        lambda: single_points(risks, files, t), lambda: high_fan_out(edges, t), lambda: god_modules(modules, files, t), lambda: long_chains(critical, t), lambda: bottlenecks(risks, files, t), lambda: untested(risks),
        lambda: circular(cycles, t), lambda: dead_modules(risks, edges), lambda: hubs(risks, edges, t), lambda: unstable_cores(fan, t), lambda: incomplete_chains(chains), lambda: orphan_endpoints(risks, links),
        lambda: hotspots(risks, t), *([lambda: hidden_coupling(contracts, edges, links, t)] if contracts is not None else []), lambda: over_exposed(modules, used, t), lambda: concentration(risks, files, t),
    ]
    with ThreadPoolExecutor(8) as pool:  # building a plan is mostly waiting for the JVM
        parts = list(pool.map(lambda make: make(), makers))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return deduplicated(out)
