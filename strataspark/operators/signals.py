"""Signals: independent observations about modules and files.

``signals(seq struct, kind, scope, strength, description, ctx)``: ``seq`` orders them (collector, then names), which
stands for the order in which another engine appends them; ``ctx`` is a map of strings. All collectors are unions of
narrow selects and joins; nothing is numbered until rules are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import names, paths
from strataspark.operators import chains, cochange

SCHEMA = "seq struct<stage:int,a:string,b:string>, kind string, scope array<string>, strength double, description string, ctx map<string,string>"


def signal(df: DataFrame, stage: int, kind: str, scope: list[str], strength: Column, description: Column, **ctx: str) -> DataFrame:
    a, b = scope[0], scope[1] if len(scope) > 1 else None
    pairs = [x for k, c in ctx.items() for x in (F.lit(k), F.col(c).cast("string"))]
    m = F.create_map(*pairs) if pairs else F.create_map()
    return df.select(
        F.struct(F.lit(stage).alias("stage"), F.col(a).alias("a"), (F.col(b) if b else F.lit("")).alias("b")).alias("seq"),
        F.lit(kind).alias("kind"), F.array(*scope).alias("scope"), strength.cast("double").alias("strength"), description.alias("description"), m.cast("map<string,string>").alias("ctx"),
    )


def fmt(text: str, *columns: Column | str) -> Column:
    return F.format_string(text, *columns)


# -- from modules


def module_pairs(modules: DataFrame) -> DataFrame:
    """(a, b, name_a, name_b) with a < b: inherently one row a pair of modules."""
    a = modules.select(F.col("id").alias("a"), F.col("name").alias("name_a"))
    b = modules.select(F.col("id").alias("b"), F.col("name").alias("name_b"))
    return a.join(b, F.col("a") < F.col("b"))


def _linked(pairs: DataFrame, deps: DataFrame) -> DataFrame:
    """Pairs with ``ab`` and ``ba``: whether each imports the other."""
    d = deps.select(F.col("module").alias("a"), F.col("dep").alias("b"), F.lit(True).alias("ab"))
    r = deps.select(F.col("dep").alias("a"), F.col("module").alias("b"), F.lit(True).alias("ba"))
    return pairs.join(d, ["a", "b"], "left").join(r, ["a", "b"], "left").fillna(False, ["ab", "ba"])


def unidirectional(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """Of each pair in order of id: the first imports the second and not the reverse. The other direction
    gives nothing. Only pairs with an import are looked at."""
    mods = modules.select("id", "name")
    fwd = deps.where("module < dep").join(deps.select(F.col("dep").alias("module"), F.col("module").alias("dep")), ["module", "dep"], "left_anti").select(F.col("module").alias("a"), F.col("dep").alias("b"))
    rows = fwd.join(mods.toDF("a", "name_a"), "a").join(mods.toDF("b", "name_b"), "b")
    return signal(rows, 10, "unidirectional", ["a", "b"], F.lit(0.6), fmt("%s uses %s, never the reverse", "name_a", "name_b"))


def no_import(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """Pairs without imports either way, where there are more than three modules."""
    n = modules.agg((F.count(F.lit(1)) > 3).alias("many"))
    rows = _linked(module_pairs(modules), deps).where("not ab and not ba").crossJoin(F.broadcast(n)).where("many")
    return signal(rows, 10, "no-import", ["a", "b"], F.lit(0.3), fmt("%s and %s don't use each other", "name_a", "name_b"))


def negative_space(modules: DataFrame, deps: DataFrame, least_imports: int = 2, least_others: int = 3, share: float = 0.5, most_absent: int = 3) -> DataFrame:
    """A module that imports most others but leaves a few out: one signal for each left out.

    The few are found by counting first, so only modules that qualify meet all others.
    """
    total = modules.agg((F.count(F.lit(1)) - 1).alias("others"))
    n = deps.groupBy("module").agg(F.count(F.lit(1)).alias("imported"))
    fit = n.crossJoin(F.broadcast(total)).withColumn("absent", F.col("others") - F.col("imported")).withColumn("selectivity", F.col("imported") / F.col("others"))
    fit = fit.where((F.col("others") >= least_others) & (F.col("imported") >= least_imports) & (F.col("selectivity") >= share) & F.col("absent").between(1, most_absent))
    mods = modules.select("id", "name")
    rows = fit.join(mods.toDF("module", "name"), "module").join(mods.toDF("dep", "dep_name"), F.col("module") != F.col("dep")).join(deps, ["module", "dep"], "left_anti")
    return signal(rows, 20, "negative-space", ["module", "dep"], F.least(F.lit(0.9), F.col("selectivity")), fmt("%s uses %d of %d modules, yet not %s", "name", "imported", "others", "dep_name"), importCount="imported", absentCount="absent", selectivity="selectivity")


def module_fan(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """(id, name, fan_in, fan_out, modules, instability)."""
    i, o = deps.groupBy(F.col("dep").alias("id")).agg(F.count(F.lit(1)).alias("fan_in")), deps.groupBy(F.col("module").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    rows = modules.select("id", "name").join(i, "id", "left").join(o, "id", "left").fillna(0, ["fan_in", "fan_out"])
    rows = rows.crossJoin(F.broadcast(modules.agg(F.count(F.lit(1)).alias("modules"))))
    return rows.withColumn("instability", F.col("fan_out") / F.greatest(F.col("fan_in") + F.col("fan_out"), F.lit(1)))


def high_fan_in(modules: DataFrame, deps: DataFrame, least: int = 3) -> DataFrame:
    rows = module_fan(modules, deps).where(F.col("fan_in") >= least)
    return signal(rows, 30, "high-fan-in", ["id"], F.least(F.lit(0.9), F.col("fan_in") / F.col("modules")), fmt("%s carries %d other modules", "name", "fan_in"), fanIn="fan_in", fanOut="fan_out", instability="instability")


def used_symbols(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, used): different first symbols on edges into a module, from inside it too.

    Files are matched by membership; a module named by a shortened path is matched all the same.
    """
    into = edges.select("dst", F.explode("refs").alias("r")).select("dst", F.col("r.symbol").alias("symbol"))
    return into.join(members.select(F.col("path").alias("dst"), "module"), "dst").groupBy(F.col("module").alias("id")).agg(F.countDistinct("symbol").alias("used"))


def export_surface(modules: DataFrame, used: DataFrame) -> DataFrame:
    rows = modules.where("n_exports > 0").join(used, "id", "left").fillna(0, ["used"]).withColumn("unused", F.greatest(F.lit(0), F.col("n_exports") - F.col("used")))
    narrow = signal(rows.where("n_exports <= 5"), 40, "narrow-api", ["id"], F.lit(0.5), fmt("%s exports just %d names", "name", "n_exports"), totalExports="n_exports", usedExternally="used", unusedExports="unused")
    idle = signal(rows.where("unused > n_exports * 0.5 and unused >= 3"), 40, "unused-exports", ["id"], F.lit(0.4), fmt("%d of the %d names that %s exports have no user", "unused", "n_exports", "name"), totalExports="n_exports", usedExternally="used", unusedExports="unused")
    return narrow.union(idle)


# -- from files


def naming_patterns(files: DataFrame, least_files: int = 3, share: float = 0.6) -> DataFrame:
    """(dir, suffix, matching, total, exceptions): directories where names mostly end alike."""
    rows = files.select(paths.dirname("path").alias("dir"), paths.basename("path").alias("file"), names.suffix_of("path").alias("suffix"))
    total = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(F.struct("file", "suffix"))).alias("all")).where(F.col("total") >= least_files)
    by = rows.where("suffix <> ''").groupBy("dir", "suffix").agg(F.count(F.lit(1)).alias("matching"))
    fit = by.join(total, "dir").where((F.col("matching") / F.col("total") >= share) & (F.col("matching") >= 2))
    return fit.select("dir", "suffix", "matching", "total", F.expr("transform(filter(all, x -> x.suffix <> suffix), x -> x.file)").alias("exceptions"))


def naming(files: DataFrame) -> DataFrame:
    rows = naming_patterns(files).withColumn("exceptions", F.array_join("exceptions", ", "))
    return signal(rows, 50, "naming-pattern", ["dir"], F.col("matching") / F.col("total") * 0.7, fmt("in %s, %d of %d names end in .%s", "dir", "matching", "total", "suffix"), matchCount="matching", totalCount="total", exceptions="exceptions")


TESTS, SOURCES = ("__tests__", "spec", "test", "tests"), ("app", "lib", "pkg", "src")


def test_alignment(files: DataFrame) -> DataFrame:
    """Directories that a test directory mirrors."""
    dirs = files.select(paths.dirname("path").alias("dir")).distinct()
    parts = F.split("dir", "/")
    rest = F.array_join(F.filter(parts, lambda p: ~p.isin(*TESTS)), "/")
    tests = dirs.where(F.arrays_overlap(parts, F.array(*map(F.lit, TESTS)))).select("dir", F.explode(F.array(*[F.concat(F.lit(s + "/"), rest) for s in SOURCES])).alias("source"))
    rows = tests.join(dirs.select(F.col("dir").alias("source")), "source")
    return signal(rows, 60, "test-alignment", ["source"], F.lit(0.4), fmt("tests in %s mirror %s", "dir", "source"), testDir="dir")


def cross_stack(files: DataFrame) -> DataFrame:
    rows = chains.cross_pairs(files)
    pairs = signal(rows, 90, "co-change", ["file_a", "file_b"], F.lit(0.7), fmt("both are about %s, in two languages", "resource"))
    steps = chains.consecutive(chains.chain_links(files, False))
    return pairs.union(signal(steps, 91, "co-change", ["file_a", "file_b"], F.lit(0.65), fmt("neighbours in the chain of %s", "resource")))


# -- from history


def from_contracts(contracts: DataFrame) -> DataFrame:
    return signal(contracts, 70, "co-change", ["file_a", "file_b"], F.least(F.lit(0.85), F.col("confidence")), fmt("changed together %d times", "occurrences"), coChangeCount="occurrences", jaccardCoefficient="confidence")


def from_removed(removed: DataFrame) -> DataFrame:
    rows = removed.withColumn("any", F.lit("*")).withColumn("n", F.lpad(F.col("ord").cast("string"), 12, "0"))
    out = signal(rows, 71, "removed-dependency", ["any"], F.lit(0.8), fmt("an import was taken out: %s", "message"), removedInCommit="hash", commitMessage="message", n="n")
    return out.withColumn("seq", F.struct(F.col("seq.stage").alias("stage"), F.col("seq.a").alias("a"), F.col("ctx")["n"].alias("b"))).withColumn("ctx", F.map_filter("ctx", lambda k, _: k != "n"))


def change_frequency(commit_files: DataFrame, members: DataFrame, modules: DataFrame, deps: DataFrame, busy: float = 0.3, least_fan_in: int = 3) -> DataFrame:
    rows = cochange.change_frequency(commit_files, members).withColumnRenamed("module", "id").join(module_fan(modules, deps), "id").where(F.col("frequency") > busy)
    pct = F.floor(F.col("frequency") * 100 + 0.5).cast("int")
    rows = rows.withColumn("pct", pct)
    often = signal(rows, 72, "change-frequency", ["id"], F.least(F.lit(0.7), F.col("frequency")), fmt("%s is in %d%% of commits", "name", "pct"), changeFrequency="frequency")
    hot = rows.where(F.col("fan_in") >= least_fan_in)
    return often.union(signal(hot, 73, "unstable-hotspot", ["id"], F.least(F.lit(0.9), F.col("frequency") * F.col("fan_in") / F.col("modules")), fmt("%s is in %d%% of commits and carries %d modules", "name", "pct", "fan_in"), changeFrequency="frequency", fanIn="fan_in"))


# -- from configuration (a handful of files at the root of the project, read on the driver)

ESLINT = (".eslintrc", ".eslintrc.js", ".eslintrc.json", ".eslintrc.yml", "eslint.config.js", "eslint.config.mjs")


def from_config(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Signals of configuration files, given as name → text. Broken JSON counts for nothing."""
    rows: list[tuple] = []

    def add(scope: Iterable[str], strength: float, description: str, name: str, rule: str) -> None:
        rows.append(((80, f"{len(rows):06d}", ""), "config-boundary", list(scope), strength, description, {"configFile": name, "configRule": rule}))

    for name in ESLINT:
        text = texts.get(name, "")
        if re.search(r"boundaries/element-types|import/no-internal-modules|no-restricted-imports", text):
            add(["*"], 0.95, f"{name} restricts imports", name, "import-restrictions")
        if found := re.findall(r"no-restricted-(?:imports|paths)", text):
            add(["*"], 0.95, f"{name} has {len(found)} rule(s) on restricted imports", name, "no-restricted-imports")

    def load(name: str) -> dict:
        try:
            got = json.loads(texts.get(name, "{}"))
        except ValueError:
            return {}
        return got if isinstance(got, dict) else {}

    ts = load("tsconfig.json")
    if aliases := list((ts.get("compilerOptions") or {}).get("paths") or {}):
        add([a.replace("/*", "", 1) for a in aliases], 0.7, f"tsconfig.json has {len(aliases)} path alias(es): {', '.join(aliases[:5])}", "tsconfig.json", "paths")
    if refs := ts.get("references"):
        add([r["path"] for r in refs], 0.9, f"tsconfig.json has {len(refs)} project reference(s)", "tsconfig.json", "references")
    spaces = load("package.json").get("workspaces") or []
    spaces = spaces if isinstance(spaces, list) else spaces.get("packages") or []
    if spaces:
        add(spaces, 0.9, f"package.json has {len(spaces)} workspace(s)", "package.json", "workspaces")
    return spark.createDataFrame(rows, SCHEMA)


def static_signals(files: DataFrame, modules: DataFrame, deps: DataFrame, members: DataFrame, edges: DataFrame, least_fan_in: int = 3) -> DataFrame:
    out = unidirectional(modules, deps)
    for more in (no_import(modules, deps), negative_space(modules, deps), high_fan_in(modules, deps, least_fan_in), export_surface(modules, used_symbols(members, edges)), naming(files), test_alignment(files)):
        out = out.union(more)
    return out
