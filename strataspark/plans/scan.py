"""A whole scan: from files and history to every table."""

from __future__ import annotations

import uuid
from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.config import EXTENSIONS, Config
from strataspark.operators import chains, cochange, graph, health, insights, modules, patterns, resolve, risk, rules, signals
from strataspark.plans.tables import cut, light_session
from strataspark.sources import extract, files, history, project
from strataspark.streaming import incremental

#: A project of at most so many files is planned lightly (see ``tables.light_session``); what comes out is the same.
FEW_FILES = 2_000
#: Version of the parsers, with which cached results go out of date.
PARSERS = 2
EMPTY_CONTRACTS = "file_a string, file_b string, occurrences long, confidence double"


def analyse(catalogue: DataFrame, config: Config = Config(), commit_files: DataFrame | None = None, diff_lines: DataFrame | None = None, change_frequency: DataFrame | None = None, previous_rules: DataFrame | None = None, manual: DataFrame | None = None, go_module: str = "", aliases: tuple[tuple[str, str], ...] = (), config_signals: DataFrame | None = None, parsed: DataFrame | None = None, now: str | None = None, languages: Collection[str] | None = None) -> dict[str, DataFrame]:
    """All tables of a scan of ``files(path, language, ext, is_support, content)``.

    Tables that several others read are written once to the shared folder. Support files stay out of graph and modules.
    """
    spark, t = catalogue.sparkSession, config.thresholds
    now = now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    everything = cut(extract.parsed(catalogue) if parsed is None else parsed, "parsed")
    results = everything.where("not is_support")
    all_files = everything.select("path", "language", "is_support")
    own = all_files.where("not is_support")

    imports = cut(resolve.resolved(extract.imports(results), own, go_module, aliases, config.resolve_absolute, config.languages if languages is None else languages), "imports")
    edges = cut(graph.build_edges(imports), "edges")
    external = graph.externals(imports)
    members = cut(modules.module_files(own, config.roots), "members")
    deps = cut(modules.module_deps(members, edges, imports, config.resolve_absolute), "deps")
    api = cut(modules.public_api(members, extract.exports(results)), "api")
    mods = cut(modules.modules(members, api, deps, modules.external_deps(members, imports)), "modules")
    empty = spark.createDataFrame([], EMPTY_CONTRACTS)
    if commit_files is not None:
        commit_files = cut(commit_files, "commits")
    contracts = cut(cochange.contracts(commit_files, config.min_confidence, t.contract_most, t.bulk_files, t.least_commits), "contracts") if commit_files is not None else empty

    def rule_table() -> tuple:
        found = signals.static_signals(own, mods, deps, members, edges, t.fan_in_signal)
        if commit_files is not None:
            found = found.union(signals.from_contracts(contracts)).union(signals.change_frequency(commit_files, members, mods, deps, t.busy_share, t.fan_in_signal))
        if diff_lines is not None:
            found = found.union(signals.from_removed(cochange.removed_imports(diff_lines)))
        if config_signals is not None:
            found = found.union(config_signals)
        pattern, from_pattern = patterns.detect(mods, deps)
        found = cut(found.union(signals.cross_stack(own)).union(from_pattern), "signals")
        ruled = rules.with_trends(rules.combine(found, now), previous_rules)
        ruled = rules.with_overrides(ruled, config.rule_overrides)
        if manual is not None:
            ruled = manual.unionByName(ruled)
        if config.check_violations:
            ruled = rules.with_violations(ruled, deps)
        return pattern, found, cut(ruled, "rules")

    def risk_table() -> tuple:
        critical = cut(graph.critical_paths(edges, t.chain_most, t.chain_least), "critical")
        impact = graph.transitive_impact(edges, own.select(F.col("path").alias("node")))
        return critical, cut(risk.file_risks(all_files, impact, graph.fan_in(edges), critical, change_frequency), "risks")

    # branches that need nothing of one another are planned and run side by side
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(f) for f in (rule_table, risk_table, lambda: modules.module_layers(mods, deps), lambda: (cut(chains.chain_links(own), "links"), graph.cycles(edges)))]
        (pattern, found, ruled), (critical, risks), layers, (links, cycles) = (j.result() for j in jobs)
    insight = cut(insights.all_insights(risks, critical, mods, edges, cycles, chains.chains(links), links, contracts if commit_files is not None else None, own, signals.module_fan(mods, deps), signals.used_symbols(members, edges), t), "insights")
    return {
        "files": all_files, "parsed": everything, "parsing_stats": extract.parsing_stats(everything), "imports": imports, "edges": edges, "nodes": graph.module_nodes(mods, external), "file_nodes": graph.build_nodes(own, edges, external),
        "members": members, "module_deps": deps, "module_exports": api, "modules": mods, "layers": layers, "contracts": cochange.with_ids(contracts), "signals": found,
        "pattern": spark.createDataFrame([pattern] if pattern else [], "pattern string, confidence double"), "rules": ruled, "critical_paths": critical, "file_risks": risks,
        "hot_files": risk.hot_files(risks, members, t.hot_most), "chain_links": links, "insights": insight, "health": health.health(ruled, mods, insight), "module_scores": health.module_scores(ruled, mods, insight),
    }


def scan_project(spark: SparkSession, root: str, config: Config = Config(), use_history: bool = True, previous_rules: DataFrame | None = None, strict_ast: bool = False, cache: str | None = None) -> dict[str, DataFrame]:
    """Scan the project at ``root``. History is an explicit input, as is the snapshot of earlier rules.

    ``cache``: a folder for parse results by content, where files that are as they were aren't parsed again.
    """
    names = files.listing(root, config) if files.local(root) is not None else None
    if names is not None and len(names) <= FEW_FILES:
        spark = light_session(spark)
        previous_rules = previous_rules and spark.createDataFrame(previous_rules.collect(), previous_rules.schema)
    catalogue = files.discover(spark, root, config, names)
    commits = history.commit_files(spark, root, config.max_commits) if use_history else None
    diffs = history.diff_lines(spark, root, min(config.max_commits, 500)) if use_history else None
    known = incremental.refresh(catalogue, f"{cache}/parsers-{PARSERS}", f"scan-{uuid.uuid4().hex[:12]}").drop("hash") if cache else None
    out = analyse(
        catalogue, config, commits, diffs, previous_rules=previous_rules, manual=rules.manual_rules(spark, f"{root}/.strata/rules.yml"),
        go_module=project.go_module(root), aliases=project.aliases(root), config_signals=signals.from_config(spark, project.config_texts(root)), parsed=known,
        languages=None if names is None else {EXTENSIONS[n[n.rindex("."):].lower()] for n in names},
    )
    if strict_ast:
        extract.assert_ast(out["parsed"])
    return out
