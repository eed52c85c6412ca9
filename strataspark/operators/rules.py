"""Rules: signals that agree about a scope, in three tiers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.plans.tables import ordinal

EVIDENCE = "first_seen string, commits_sampled int, recent_violations int, total_instances int, matching_instances int, promoted_from string, details string"
SCHEMA = f"id string, category string, tier string, confidence double, trend string, scope array<string>, description string, action string, source string, evidence struct<{', '.join(x.replace(' ', ':', 1) for x in EVIDENCE.split(', '))}>"


def scope_key(scope: Column | str = "scope") -> Column:
    return F.array_join(F.array_sort(scope), "|")


def groups(signals: DataFrame) -> DataFrame:
    """One row a scope, with what tier, category and texts follow from. Signals are ordered by ``seq``; of
    equally strong ones the first is the main one."""
    order = F.struct("seq", "kind")
    plain = signals.withColumn("key", scope_key()).withColumn("cc", F.coalesce(F.expr("try_cast(ctx['coChangeCount'] AS INT)"), F.lit(0)))
    return plain.groupBy("key").agg(
        F.min("seq").alias("seq"), F.min_by("scope", order).alias("scope"), F.count(F.lit(1)).alias("n"), F.avg("strength").alias("avg"), F.max("strength").alias("top"),
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.min_by("description", F.struct((-F.col("strength")).alias("s"), "seq", "kind")).alias("main"),
        F.min_by("kind", F.struct((-F.col("strength")).alias("s"), "seq", "kind")).alias("main_kind"), F.max("cc").alias("commits"),
        F.array_sort(F.collect_list(F.struct("seq", "kind", "strength"))).alias("each"),
        *[F.min_by(F.col("ctx")[key], order if kind is None else F.when(F.col("kind") == kind, order)).alias(alias) for alias, kind, key in _CONTEXT],
    )


#: Values of the first signal of a kind that texts use: (alias, kind, key).
_CONTEXT = (
    ("c_selectivity", "negative-space", "selectivity"), ("c_imports", "negative-space", "importCount"), ("c_fan_in", "high-fan-in", "fanIn"), ("c_hot_fan_in", "unstable-hotspot", "fanIn"),
    ("c_message", "removed-dependency", "commitMessage"), ("c_file", "config-boundary", "configFile"), ("c_expected", "arch-pattern-match", "expectedRule"), ("c_pattern", "arch-pattern-match", "detectedPattern"), ("c_count", "co-change", "coChangeCount"),
)


def _has(*kinds: str) -> Column:
    return F.arrays_overlap("kinds", F.array(*map(F.lit, kinds)))


def confidence() -> Column:
    return F.least(F.lit(0.99), F.col("avg") + F.least(F.lit(0.2), F.size("kinds") * 0.05))


def tier() -> Column:
    """The ladder of tiers. One strong signal makes a convention, several of one kind don't."""
    k = F.size("kinds")
    return (
        F.when(_has("config-boundary"), "rule").when(_has("arch-pattern-match", "removed-dependency") & (k >= 2), "rule").when((k >= 3) & (F.col("top") >= 0.6), "rule")
        .when(k >= 2, "convention").when((F.col("n") == 1) & (F.col("top") >= 0.8), "convention").otherwise("observation")
    )


def category() -> Column:
    return F.when(_has("naming-pattern"), "naming").when(_has("co-change", "change-frequency", "unstable-hotspot"), "co-change").when(_has("layer-position", "arch-pattern-match"), "layer").otherwise("boundary")


def source() -> Column:
    return F.when(_has("config-boundary"), "manual").when(_has("co-change", "removed-dependency", "change-frequency"), "git-history").otherwise("static-analysis")


def description() -> Column:
    """The main signal's text, and notes on the other kinds."""
    other = lambda kind: _has(kind) & ((F.col("main_kind") != kind) | (F.size(F.filter("each", lambda e: e["kind"] == kind)) > 1))
    pct = F.floor(F.col("c_selectivity").cast("double") * 100 + 0.5).cast("int")
    notes = [
        F.when(other("negative-space") & F.col("c_selectivity").isNotNull(), F.format_string("[left out on purpose: it uses %d%% of the others]", pct)),
        F.when(other("high-fan-in") & F.col("c_fan_in").isNotNull(), F.format_string("[%s modules rest on it]", "c_fan_in")),
        F.when(other("arch-pattern-match") & F.col("c_pattern").isNotNull(), F.format_string("[fits %s]", "c_pattern")),
        F.when(other("removed-dependency") & F.col("c_message").isNotNull(), F.format_string("[import taken out: %s]", "c_message")),
        F.when(other("config-boundary") & F.col("c_file").isNotNull(), F.format_string("[set in %s]", "c_file")),
    ]
    return F.concat_ws(" ", "main", *notes)


def action() -> Column:
    s0, s1 = F.get("scope", F.lit(0)), F.coalesce(F.get("scope", F.lit(1)), F.lit("it"))
    pair = F.array_join("scope", " and ")
    return (
        F.when(_has("config-boundary"), F.format_string("Linting enforces this (%s); change the configuration before adding such an import.", "c_file"))
        .when(_has("arch-pattern-match"), F.format_string("Keep to %s: %s.", "c_pattern", F.coalesce("c_expected", F.lit("respect its layers"))))
        .when(_has("unstable-hotspot"), F.format_string("%s changes often under %s dependents: settle its interface.", s0, "c_hot_fan_in"))
        .when(_has("negative-space") & _has("unidirectional"), F.format_string("With %s imports elsewhere, leaving out %s looks meant; ask before adding it.", "c_imports", s1))
        .when(_has("co-change") & (F.col("tier") == "rule"), F.format_string("Always look at %s together (%s joint changes).", pair, F.coalesce("c_count", F.lit("several"))))
        .when(_has("co-change"), F.format_string("Look at %s together when one changes.", pair))
        .when(F.col("tier") == "rule", F.format_string("Don't break this; %d signals agree.", "n"))
        .when(F.col("tier") == "convention", F.format_string("Keep to this without a reason not to; %d signal(s).", "n"))
        .otherwise("For information.")
    )


def combine(signals: DataFrame, now: str = "") -> DataFrame:
    """Rules of signals; ids ``category-NNN`` number all scopes in the order of their first signals."""
    g = groups(signals).withColumn("category", category()).withColumn("tier", tier()).withColumn("stage", F.col("seq.stage")).withColumn("a", F.col("seq.a"))
    g = ordinal(g, ["stage", "a"], ["seq", "key"])
    n = F.greatest(F.length(F.col("ordinal").cast("string")), F.lit(3))
    details = F.to_json(F.struct(F.col("kinds").alias("signalKinds"), F.col("n").alias("signalCount"), F.size("kinds").alias("uniqueKinds"), F.transform("each", lambda e: F.struct(e["kind"].alias("kind"), e["strength"].alias("strength"))).alias("individualStrengths")))
    count = F.col("n").cast("int")
    evidence = F.struct(F.lit(now).alias("first_seen"), F.col("commits").alias("commits_sampled"), F.lit(0).alias("recent_violations"), count.alias("total_instances"), count.alias("matching_instances"), F.lit(None).cast("string").alias("promoted_from"), details.alias("details"))
    return g.select(F.concat("category", F.lit("-"), F.lpad(F.col("ordinal").cast("string"), n, F.lit("0"))).alias("id"), "category", "tier", confidence().alias("confidence"), F.lit("new").alias("trend"), "scope", description().alias("description"), action().alias("action"), source().alias("source"), evidence.alias("evidence"))


def trend(delta: Column) -> Column:
    return F.when(delta > 0.05, "strengthening").when(delta < -0.2, "broken").when(delta < -0.05, "weakening").otherwise("stable")


def with_trends(rules: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Trend of each rule against the previous one of its category and scope; then decay: what weakens twice in a row loses a tier."""
    if previous is None:
        return rules
    key = lambda df: df.withColumn("__key", F.concat_ws("#", "category", F.array_join(F.array_sort("scope"), ",")))
    last = key(previous).groupBy("__key").agg(F.min_by(F.struct("confidence", "trend", F.col("evidence.first_seen").alias("seen")), "id").alias("__p"))
    rows = key(rules).join(last, "__key", "left")
    now = F.when(F.col("__p").isNull(), "new").otherwise(trend(F.col("confidence") - F.col("__p.confidence")))
    falling = now.isin("weakening", "broken") & F.coalesce(F.col("__p.trend").isin("weakening", "broken"), F.lit(False))
    lower = F.when(F.col("tier") == "rule", "convention").otherwise("observation")
    sinks = falling & (lower != F.col("tier"))
    evidence = F.col("evidence").withField("first_seen", F.coalesce(F.when(F.col("__p.seen") != "", F.col("__p.seen")), F.col("evidence.first_seen"))).withField("promoted_from", F.when(sinks, F.col("tier")).otherwise(F.col("evidence.promoted_from")))
    return rows.select("id", "category", F.when(sinks, lower).otherwise(F.col("tier")).alias("tier"), "confidence", now.alias("trend"), "scope", "description", "action", "source", evidence.alias("evidence"))


def with_overrides(rules: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """``suppress`` drops a rule, ``promote:rule`` and ``promote:convention`` set its tier."""
    if not overrides:
        return rules
    gone = [i for i, v in overrides.items() if v == "suppress"]
    out = rules.where(~F.col("id").isin(*gone)) if gone else rules
    for t in ("rule", "convention"):
        ids = [i for i, v in overrides.items() if v == f"promote:{t}"]
        if ids:
            out = out.withColumn("tier", F.when(F.col("id").isin(*ids), t).otherwise(F.col("tier")))
    return out


def manual_rules(spark: SparkSession, path: str | Path, now: str = "") -> DataFrame:
    """Rules of a YAML file (list, or under ``rules``): ``manual-NNN``, tier rule, confidence 1; none where it is missing or broken,
    and entries that aren't mappings don't count."""
    rows = []
    try:
        text = Path(path).read_text()
    except (OSError, ValueError):
        text = ""
    for i, r in enumerate(_entries(text), 1):
        scope = r.get("scope") or ["*"]
        rows.append((f"manual-{i:03d}", str(r.get("category") or "boundary"), "rule", 1.0, "stable", [str(s) for s in (scope if isinstance(scope, list) else [scope])], str(r.get("description") or ""), str(r.get("action") or r.get("description") or ""), "manual", (now, 0, 0, 0, 0, None, None)))
    return spark.createDataFrame(rows, SCHEMA)


def _entries(text: str) -> list[dict]:
    try:
        import yaml
    except ImportError:
        return _simple_yaml(text)
    try:
        got = yaml.safe_load(text)
    except yaml.YAMLError:
        return []
    got = got.get("rules") if isinstance(got, dict) else got
    return [r for r in got if isinstance(r, dict)] if isinstance(got, list) else []


def _simple_yaml(text: str) -> list[dict]:
    """The subset that rule files use: a list of flat mappings, with ``[a, b]`` lists."""
    out: list[dict] = []
    for line in text.splitlines():
        s = line.split(" #")[0].strip()
        if not s or s.startswith("#") or s == "rules:":
            continue
        if s.startswith("- "):
            out.append({})
            s = s[2:]
        if ":" in s and out:
            k, v = (x.strip() for x in s.split(":", 1))
            out[-1][k] = [x.strip().strip("'\"") for x in v[1:-1].split(",")] if v.startswith("[") else v.strip("'\"")
    return out


_OLD = {"boundary": "boundary", "co-change": "co-change", "naming-convention": "naming", "naming": "naming", "layer": "layer", "ownership": "ownership", "layering": "layer"}


def migrate_v1(old: DataFrame) -> DataFrame:
    """Rules of version 1 (id, type, confidence, description, source, evidence map<string,string> with ``modules``
    or ``files`` as comma-separated lists) in the present form. Rows that have a tier already pass unchanged in it."""
    cat = F.coalesce(F.create_map(*[F.lit(x) for p in sorted(_OLD.items()) for x in p])[F.col("type")], F.lit("boundary"))
    own_tier = F.col("tier") if "tier" in old.columns else F.lit(None).cast("string")
    new_tier = F.when((F.col("type") == "boundary") & (F.col("confidence") >= 0.95), "rule").when(F.col("confidence") >= 0.8, "convention").otherwise("observation")
    listed = F.coalesce(F.col("evidence")["modules"], F.col("evidence")["files"])
    return old.select("id", cat.alias("category"), F.coalesce(own_tier, new_tier).alias("tier"), "confidence", F.lit("stable").alias("trend"), F.when(listed.isNotNull(), F.split(listed, ",")).otherwise(F.array(F.lit("*"))).alias("scope"), "description", F.lit("").alias("action"), "source")


def with_violations(rules: DataFrame, deps: DataFrame) -> DataFrame:
    """Extension, off by default: counts the module dependencies that go against rules on two modules which should not use each other."""
    rows = rules.where((F.size("scope") == 2) & F.col("category").isin("boundary", "layer")).select("id", F.get("scope", F.lit(0)).alias("module"), F.get("scope", F.lit(1)).alias("dep"), F.col("evidence.details").contains("unidirectional").alias("one_way"))
    hit = rows.where("not one_way").join(deps, ["module", "dep"]).select("id").union(rows.join(deps.select(F.col("module").alias("dep"), F.col("dep").alias("module")), ["module", "dep"]).where("one_way").select("id"))
    n = hit.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("__n"))
    return rules.join(n, "id", "left").withColumn("evidence", F.col("evidence").withField("recent_violations", F.coalesce("__n", F.lit(0)))).drop("__n").select(*rules.columns)
