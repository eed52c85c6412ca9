import json
import subprocess

import pytest
from pyspark.sql import functions as F

from strataspark.config import Config, load_config, write_default_config
from strataspark.functions import names, paths
from strataspark.operators import api, chains, cochange, delta, health, insights, modules, patterns, resolve, risk, rules, signals
from strataspark.sources import files, history, project, sinks
from strataspark.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


# -- functions


def test_paths(spark):
    assert one(spark, paths.normalise("p"), ["a/./b/../c", "../x", "./a//b/", "a/b/../../..", ""]) == ["a/c", "../x", "a/b", "..", ""]
    assert one(spark, paths.dirname("p"), ["a/b/c.ts", "c.ts"]) == ["a/b", "."] and one(spark, paths.extension("p"), ["a.b/c", "x.d.ts"]) == ["", ".ts"]
    assert one(spark, paths.is_test("p"), ["a/x.test.ts", "test_a.py", "a/tests/b.py", "contest.py", "a_test.go"]) == [True, True, True, False, True]
    assert one(spark, paths.is_support("p"), ["docs/a.py", "src/Tests/a.py", "src/app.py", "benchmarks/x.go", "scripts/a.ts", "latest/a.ts"]) == [True, True, False, True, True, False]
    assert one(spark, paths.is_entry_point("p"), ["a/Index.ts", "b/__init__.py", "c/other.py"]) == [True, True, False]


def test_names(spark):
    got = one(spark, names.resource_name("p"), ["src/hooks/useOrders.ts", "app/services/crew_service.py", "pages/CitiesPage.tsx", "a/buses.py", "a/index.ts", "a/class.py", "a/ab.py", "x/users.routes.ts", "a/MainLayout.tsx"])
    assert got == ["order", "crew_", "city", "bus", None, "class", None, "rs.", "main"]
    assert one(spark, names.resource_name("p", False), ["a/database.py", "a/MainLayout.tsx"]) == ["database", "mainlayout"] and one(spark, names.resource_name("p"), ["a/database.py"]) == [None]
    assert one(spark, names.role("p"), ["a/models/x.py", "a/API/x.py", "a/dto/x.py", "x/tests/y.py", "b/x.py"]) == ["model", "api", "schema", "test", "other"]


def test_ignore(spark):
    lines = ["# c", "", "build/", "*.log", "/only.ts", "a/**/z.ts", "!keep.log"]
    got = one(spark, files.is_ignored("p", lines), ["build/x.ts", "a/build/x.ts", "x.log", "keep.log", "only.ts", "b/only.ts", "a/q/r/z.ts", "a/z.ts", "src/x.ts"])
    assert got == [True, True, True, False, True, False, True, True, False]


# -- resolution


def resolved(spark, language, imports, paths_, **how):
    i = spark.createDataFrame([(f, language, n, s, ["x"], rel, False, 1) for n, (f, s, rel) in enumerate(imports)], "path string, language string, ord int, source string, specifiers array<string>, is_relative boolean, is_dynamic boolean, line int")
    return [r.target for r in resolve.resolved(i, spark.createDataFrame([(p,) for p in paths_], "path string"), **how).orderBy("ord").collect()]


def test_resolve_javascript(spark):
    own = ["src/a.ts", "src/b/index.tsx", "src/c.js", "src/c.js.ts", "src/d.tsx", "src/d.js", "src/e/index.js", "src/e.mts", "lib/x.ts", "lib/y/index.ts"]
    imports = [("src/m.ts", s, True) for s in ("./a.js", "./b", "./c.js", "./d", "./e", "./none", "../lib/x", ".")] + [("src/m.ts", s, False) for s in ("@/x", "@/y", "react")]
    want = ["src/a.ts", "src/b/index.tsx", "src/c.js", "src/d.tsx", "src/e.mts", None, "lib/x.ts", None, "lib/x.ts", "lib/y/index.ts", None]
    assert resolved(spark, "typescript", imports, own, aliases=(("@/", "lib/"),)) == want


def test_resolve_python(spark):
    own = ["be/app/__init__.py", "be/app/m/user.py", "be/app/m/__init__.py", "be/app/util.py", "tools/run.py", "top.py"]
    imports = [("be/app/m/user.py", s, True) for s in ("..util", ".", "..", ".none")] + [("x.py", s, False) for s in ("app.m.user", "app.m.user.User", "app", "app.m", "tools.run", "os")]
    assert resolved(spark, "python", imports, own) == ["be/app/util.py", "be/app/m/__init__.py", "be/app/__init__.py", None, "be/app/m/user.py", "be/app/m/user.py", "be/app/__init__.py", "be/app/m/__init__.py", "tools/run.py", None]


def test_resolve_rust_java_go(spark):
    rs = ["src/a.rs", "src/b/mod.rs", "src/b/c.rs", "src/lib.rs"]
    assert resolved(spark, "rust", [("src/lib.rs", s, True) for s in ("a", "b", "crate::b::c", "crate::a::Thing", "crate::zz")] + [("src/b/c.rs", "super::a", True), ("src/b/c.rs", "self::b::c", True)], rs) == ["src/a.rs", "src/b/mod.rs", "src/b/c.rs", "src/a.rs", None, "src/a.rs", "src/b/c.rs"]
    java = ["src/main/java/com/ex/svc/User.java", "src/main/java/com/ex/Main.java", "o/org/low/thing/T.java"]
    assert resolved(spark, "java", [("m", "com.ex.svc", True), ("m", "com.ex.Main", False), ("m", "org.low.thing", False), ("m", "low", False), ("m", "java.util", False)], java) == [java[0], java[1], java[2], java[2], None]
    go = ["pkg/auth/b.go", "pkg/auth/a.go", "pkg/deep/x/y.go"]
    imports = [("m.go", "ex.com/app/pkg/auth", True), ("m.go", "ex.com/app/pkg/deep", True), ("m.go", "fmt", False)]
    assert resolved(spark, "go", imports, go, go_module="ex.com/app") == [None] * 3
    assert resolved(spark, "go", imports, go, go_module="ex.com/app", resolve_absolute=True) == ["pkg/auth/a.go", "pkg/deep/x/y.go", None]


# -- co-change


def test_contracts(spark):
    log = [(f"c{i}", p) for i in range(60) for p in (["x/A.py", "y/B.ts"] if i < 5 else ["x/A.py"] if i == 5 else [f"z/only{i}.py"])]
    log += [(f"c{i}", p) for i in range(10, 20) for p in ("d/e.py", "d/f.py", "d/e.ts")] + [(f"c{i}", p) for i in (20, 21) for p in ("g/h.py", "i/j.py")] + [("c30", f"bulk/{k}/f.py") for k in range(21)]
    got = rows(cochange.contracts(spark.createDataFrame(log, "hash string, path string")).select("file_a", "file_b", "occurrences", F.round("confidence", 4)))
    assert ("x/A.py", "y/B.ts", 5, 0.8333) in got and ("d/e.py", "d/e.ts", 10, 1.0) in got and not any("d/f.py" in r and "d/e.py" in r for r in got) and not any("g/h.py" in r or "bulk" in r[0] for r in got)
    assert [cochange.least_support(n) for n in (49, 50, 199, 200)] == [2, 3, 3, 5]
    few = spark.createDataFrame(log[:8], "hash string, path string")
    assert cochange.contracts(few).count() == 0
    assert cochange.with_ids(cochange.contracts(spark.createDataFrame(log, "hash string, path string"))).orderBy("id").first().id == "contract-001"


def test_log_and_removed_imports(spark, monkeypatch):
    h = "a" * 40, "b" * 40
    lines = [h[0], "", "1\t2\tapp/x.py", "-\t-\tapp/pic.png", "3\t0\tapp/{a => b}.py", h[1], "1\t1\tother/y.py", "2\t2\tapp/z.py"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    assert rows(history.parse_log(df, "app/")) == [(h[0], "x.py"), (h[1], "z.py")]
    monkeypatch.setattr(history, "STRETCH", 1)
    assert rows(history.parse_log(df, "app/")) == [(h[0], "x.py"), (h[1], "z.py")]
    diff = [(0, "h1", "Refactor core", "-import x"), (0, "h1", "Refactor core", "--- a"), (1, "h2", "Remove y", "+import y"), (2, "h3", "add", "-import z"), (3, "h4", "split out", "-use q")]
    assert rows(cochange.removed_imports(spark.createDataFrame(diff, "ord int, hash string, message string, line string")).select("hash")) == [("h1",), ("h4",)]


# -- signals, patterns, rules


def mods(spark, deps, n_exports=3):
    m = spark.createDataFrame([(f"src/{k}", k, [f"src/{k}/index.ts"], n_exports) for k in deps], "id string, name string, files array<string>, n_exports int")
    return m, spark.createDataFrame([(f"src/{k}", f"src/{x}") for k, v in deps.items() for x in v], "module string, dep string")


def test_signals(spark):
    m, d = mods(spark, {"a": ["b"], "b": [], "api": ["a", "b", "c"], "c": [], "legacy": []})
    scopes = lambda df: {tuple(s.split("/")[1] for s in r.scope) for r in df.collect()}
    assert scopes(signals.unidirectional(m, d)) == {("a", "b"), ("api", "b"), ("api", "c")}
    assert ("a", "legacy") in scopes(signals.no_import(m, d)) and ("a", "api") not in scopes(signals.no_import(m, d))
    (ns,) = signals.negative_space(m, d).collect()
    assert ns.scope == ["src/api", "src/legacy"] and ns.strength == 0.75
    m, d = mods(spark, {"u": [], "a": ["u"], "b": ["u"], "c": ["u"], "d": ["u"]})
    (hf,) = signals.high_fan_in(m, d).collect()
    assert hf.ctx["fanIn"] == "4" and hf.strength == 0.8
    f = spark.createDataFrame([(f"src/r/{n}",) for n in ("a.route.ts", "b.route.ts", "c.route.ts", "x.ts")] + [("tests/r/a.ts",)], "path string")
    (n,) = signals.naming(f).collect()
    assert n.scope == ["src/r"] and abs(n.strength - 0.525) < 1e-9 and n.ctx["exceptions"] == "x.ts"
    assert [r.scope for r in signals.test_alignment(f).collect()] == [["src/r"]]


def test_config_signals(spark):
    texts = {".eslintrc.json": '{"rules": {"no-restricted-imports": 1, "no-restricted-paths": 2}}', "tsconfig.json": json.dumps({"compilerOptions": {"paths": {"@/*": ["src/*"]}}, "references": [{"path": "./p"}]}), "package.json": '{"workspaces": {"packages": ["a", "b"]}}'}
    got = [(r.scope, r.strength) for r in signals.from_config(spark, texts).orderBy("seq").collect()]
    assert got == [(["*"], 0.95), (["*"], 0.95), (["@"], 0.7), (["./p"], 0.9), (["a", "b"], 0.9)]
    assert signals.from_config(spark, {"package.json": "{broken"}).count() == 0


def test_patterns(spark):
    found = lambda names_: tuple(patterns.best(patterns.confidences(*mods(spark, dict.fromkeys(names_, ["zz"]) | {"zz": list(names_)}))).first() or ())[::2]
    assert found(["models", "views", "controllers"])[0] == "mvc"
    assert found(["domain", "services", "infrastructure", "handlers"]) == ("clean-architecture", 1.0)
    assert found(["ports", "adapters", "core"])[0] == "hexagonal"
    m, d = mods(spark, {"x": [], "y": [], "q": []})
    chosen, sig = patterns.detect(m, d)
    assert chosen == ("feature-based", 1.0) and sig.first().scope == ["src/q", "src/x", "src/y"]
    assert patterns.detect(*mods(spark, {"x": []}))[0] is None


def sig(spark, *kinds, strength=0.5):
    data = [((1, f"{i:03d}", ""), k, ["a", "b"], strength, k, {"configFile": "f", "selectivity": "0.6", "importCount": "3"}) for i, k in enumerate(kinds)]
    return spark.createDataFrame(data, signals.SCHEMA)


def test_tiers(spark):
    tier = lambda *k, **s: rules.combine(sig(spark, *k, **s)).first().tier
    assert tier("no-import") == "observation" and tier("no-import", "negative-space") == "convention" and tier("no-import", "negative-space", "co-change", strength=0.6) == "rule"
    assert tier("config-boundary") == "rule" and tier("arch-pattern-match", "no-import") == "rule" and tier("removed-dependency", strength=0.8) == "convention" and tier("removed-dependency", "removed-dependency", strength=0.8) == "observation"
    r = rules.combine(sig(spark, "negative-space", "unidirectional")).first()
    assert "3 imports" in r.action and r.id == "boundary-001" and r.confidence == pytest.approx(0.6) and r.evidence.recent_violations == 0 and json.loads(r.evidence.details)["uniqueKinds"] == 2


def previous(spark, rule, confidence, trend="stable"):
    return rule.withColumn("confidence", F.lit(confidence)).withColumn("trend", F.lit(trend)).withColumn("scope", F.array(F.lit("b"), F.lit("a"))).withColumn("evidence", F.col("evidence").withField("first_seen", F.lit("2020")))


def test_trends_decay_overrides(spark):
    now = rules.combine(sig(spark, "no-import", "negative-space"), "2024")
    c = now.first().confidence
    got = {d: rules.with_trends(now, previous(spark, now, c - d)).first() for d in (0.06, 0.0, -0.06, -0.21)}
    assert [got[d].trend for d in got] == ["strengthening", "stable", "weakening", "broken"] and got[0.0].evidence.first_seen == "2020"
    down = rules.with_trends(now, previous(spark, now, c + 0.1, "weakening")).first()
    assert (down.tier, down.evidence.promoted_from) == ("observation", "convention")
    assert rules.with_trends(now, now.limit(0)).first().trend == "new" and rules.with_trends(now, None).first().trend == "new"
    assert rules.with_overrides(now, {"boundary-001": "suppress"}).count() == 0 and rules.with_overrides(now, {"boundary-001": "promote:rule"}).first().tier == "rule"


def test_manual_and_old_rules(spark, tmp_path):
    (tmp_path / "rules.yml").write_text("rules:\n  - description: keep db away\n    scope: [src/a, src/b]\n    category: layer\n  - description: second\n")
    got = [(r.id, r.tier, r.category, r.scope) for r in rules.manual_rules(spark, tmp_path / "rules.yml").orderBy("id").collect()]
    assert got == [("manual-001", "rule", "layer", ["src/a", "src/b"]), ("manual-002", "rule", "boundary", ["*"])]
    assert rules.manual_rules(spark, tmp_path / "none.yml").count() == 0
    old = spark.createDataFrame([("1", "boundary", 0.95, "d", "s", {"modules": "a,b"}), ("2", "co-change", 0.7, "d", "s", {"files": "f"}), ("3", "naming-convention", 0.88, "d", "s", None)], "id string, type string, confidence double, description string, source string, evidence map<string,string>")
    assert [(r.tier, r.category, r.scope) for r in rules.migrate_v1(old).orderBy("id").collect()] == [("rule", "boundary", ["a", "b"]), ("observation", "co-change", ["f"]), ("convention", "naming", ["*"])]
    keep = rules.migrate_v1(old.withColumn("tier", F.lit("observation")))
    assert {r.tier for r in keep.collect()} == {"observation"}


def test_violations_extension(spark):
    r = rules.combine(sig(spark, "no-import", "negative-space"))
    d = spark.createDataFrame([("a", "b")], "module string, dep string")
    assert rules.with_violations(r, d).first().evidence.recent_violations == 1 and rules.with_violations(r, d.limit(0)).first().evidence.recent_violations == 0
    assert not api.passes(rules.with_violations(rules.combine(sig(spark, "config-boundary", strength=0.9)), d)) and api.passes(r)


# -- risk, chains, insights, health, delta


def test_chain(spark):
    f = spark.createDataFrame([("be/models/order.py", "python"), ("be/schemas/order.py", "python"), ("be/api/orders.py", "python"), ("fe/hooks/useOrders.ts", "typescript"), ("be/models/zorder.py", "python"), ("x/a.py", "python")], "path string, language string")
    links = chains.chain_links(f)
    (c,) = chains.chains(links).collect()
    assert (c.resource, c.roles, c.is_cross_stack) == ("order", ["model", "schema", "api", "hook"], True)
    assert [(r.severity, r.id) for r in insights.incomplete_chains(chains.chains(links)).collect()] == [("info", "incomplete-chain:service:order")]
    assert chains.consecutive(links).count() == 3 and chains.cross_pairs(f).count() == 3
    assert chains.chain_links(f.limit(0)).count() == 0


def test_risk_and_tests(spark):
    f = spark.createDataFrame([("src/a.ts", False), ("src/b.ts", False), ("tests/a.test.ts", True), ("t/test_b.py", False)], "path string, is_support boolean")
    assert [(r.file, r.test_files) for r in risk.test_mapping(f).orderBy("file").collect()] == [("src/a.ts", ["tests/a.test.ts"]), ("src/b.ts", ["t/test_b.py"])]
    impact = spark.createDataFrame([("src/a.ts", 4), ("tests/a.test.ts", 9)], "node string, impact long")
    fan = spark.createDataFrame([("src/a.ts", 2), ("src/b.ts", 6)], "node string, fan_in long")
    critical = spark.createDataFrame([(["src/b.ts"],)], "files array<string>")
    freq = spark.createDataFrame([("src/b.ts", 0.5)], "path string, frequency double")
    got = {r.file: (r.score, r.risk) for r in risk.file_risks(f, impact, fan, critical, freq).collect()}
    assert got == {"src/a.ts": (22, "low"), "src/b.ts": (100, "critical"), "tests/a.test.ts": (0, "low"), "t/test_b.py": (0, "low")}


def test_health_and_delta(spark):
    m = spark.createDataFrame([("a", ["a/1", "a/2", "a/3"]), ("b", ["b/1"])], "id string, files array<string>")
    r = spark.createDataFrame([("1", "boundary", "rule", "stable", ["a"], (1,)), ("2", "naming", "convention", "weakening", ["b"], (1,)), ("3", "layer", "observation", "stable", ["*"], (0,))], "id string, category string, tier string, trend string, scope array<string>, evidence struct<recent_violations:int>")
    i = spark.createDataFrame([("x", "bottleneck", "critical", "a/1", None), ("y", "god-module-size", "warning", None, "b")], "id string, metric string, severity string, file string, module string")
    h = health.health(r, m, i).first()
    assert h.overall == round(100 - 15 * 1.5 * 1.5 - 5 * 0.5 * 0.5 - 3 - 2 - 1) and h.trend == "weakening" and (h.rules, h.rule_violations) == (1, 1)
    assert rows(health.module_scores(r, m, i)) == [("a", 75, 2), ("b", 97, 1)]
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert delta.delta_edges(e, e).count() == 0 and rows(delta.delta_edges(e, e.limit(1))) == [("removed", "b", "c")]
    t = lambda *x: spark.createDataFrame(list(x), "id string, tier string")
    assert rows(delta.delta_rules(t(("1", "rule"), ("2", "convention"), ("3", "rule")), t(("2", "rule"), ("3", "observation"), ("4", "rule"), ("5", "rule")))) == [(2, 1, 1, 1)]
    assert rows(delta.delta_rules(t(), t())) == [(0, 0, 0, 0)]
    k = lambda *x: spark.createDataFrame(list(x), "file string, risk string")
    assert rows(delta.delta_risk(k(("f", "low"), ("g", "low")), k(("f", "high"), ("g", "low"), ("h", "high")))) == [("f", "low", "high")]


def test_insight_rules(spark):
    risks = spark.createDataFrame([("hub.py", 100, 20, 30, True), ("b.py", 50, 12, 5, False), ("c.py", 10, 0, 0, False), ("src/api/x.py", 5, 0, 0, False)], "file string, score int, fan_in int, transitive_impact int, on_critical_path boolean").withColumn("change_frequency", F.lit(0.35))
    f = spark.createDataFrame([(f"f{i}",) for i in range(60)], "path string")
    edges = spark.createDataFrame([("b.py", f"d{i}") for i in range(9)] + [("c.py", "b.py")], "src string, dst string")
    found = insights.single_points(risks, f).unionByName(insights.bottlenecks(risks, f)).unionByName(insights.high_fan_out(edges)).unionByName(insights.hubs(risks, edges))
    assert {(r.metric, r.file) for r in insights.deduplicated(found).collect()} == {("bottleneck", "hub.py"), ("hub-file", "b.py")}
    assert {r.file for r in insights.dead_modules(risks, edges).collect()} == {"c.py", "src/api/x.py"}
    assert {(r.file, r.severity) for r in insights.hotspots(risks).collect()} == {("hub.py", "warning"), ("b.py", "warning")}
    assert insights.concentration(risks, f).first().severity == "critical" and insights.concentration(risks, f.limit(3)).count() == 0
    assert insights.orphan_endpoints(risks, spark.createDataFrame([], "file string")).first().file == "src/api/x.py"
    c = spark.createDataFrame([("p", "q", 9, 0.95), ("b.py", "c.py", 9, 0.95), ("m", "n", 9, 0.8), ("u", "v", 9, 0.5)], "file_a string, file_b string, occurrences long, confidence double")
    links = spark.createDataFrame([("r", "m"), ("r", "n")], "resource string, file string")
    assert [(r.severity, r.id) for r in insights.hidden_coupling(c, edges, links).collect()] == [("warning", "hidden-coupling:p|q")]


# -- api, config, adapters


def test_api(spark):
    m, _ = mods(spark, {"a": [], "b": []})
    m = m.withColumn("language", F.lit("typescript")).withColumn("internal_deps", F.array().cast("array<string>")).withColumn("external_deps", F.array().cast("array<string>"))
    ex = spark.createDataFrame([("src/a", "f", 0, "go", "function", 1)], "module string, path string, ord int, name string, kind string, line int")
    assert api.get_modules(m, ex).where("id = 'src/a'").first().public_api == ["go (function)"]
    assert api.get_module(m, "b").first().id == "src/b"
    with pytest.raises(KeyError, match="src/a, src/b"):
        api.get_module(m, "nope")
    e = spark.createDataFrame([("src/a/x", "src/b/y", "import", 1), ("lib/q/r", "src/b/y", "import", 1)], "src string, dst string, type string, weight int")
    members = spark.createDataFrame([("src/b", "src/b/y"), ("src/a", "src/a/x")], "module string, path string")
    assert api.get_dependencies(e, "src/a").count() == 1 and api.get_dependencies(e).count() == 2
    assert rows(api.depended_on_by(e, members, "src/b")) == [("lib/q",), ("src/a",)]
    c = spark.createDataFrame([("src/b/y", "z", 3, 0.9)], "file_a string, file_b string, occurrences long, confidence double")
    links = spark.createDataFrame([("r", "model", "src/b/y"), ("r", "api", "w")], "resource string, role string, file string")
    got = api.check_impact("src/b/y", members, e, c, links)
    assert {k: v.count() for k, v in got.items()} == {"module": 1, "dependents": 2, "contracts": 1, "chain": 2}
    assert rows(api.defining_module(members, ex, "src/b/y", "go")) == [("src/a",)]
    r = rules.combine(sig(spark, "no-import", "negative-space"))
    assert api.get_rules(r, tier="convention").count() == 1 and api.get_rules(r, category="layer").count() == 0 and api.get_rules(r, min_confidence=0.99).count() == 0 and api.top_per_tier(r, 1).count() == 1


def test_config(tmp_path):
    path = tmp_path / "c.json"
    assert write_default_config(path) and not write_default_config(path)
    assert load_config(path) == Config() and load_config(tmp_path / "none") == Config()
    path.write_text('{"roots": ["app"], "unknown": 1}')
    assert load_config(path).roots == ("app",) and load_config(path).languages == Config().languages
    path.write_text("{broken")
    assert load_config(path) == Config()
    (tmp_path / "go.mod").write_text("module ex.com/app\n\ngo 1.2\n")
    (tmp_path / "tsconfig.json").write_text('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "none": []}}}')
    assert project.go_module(str(tmp_path)) == "ex.com/app" and project.aliases(str(tmp_path)) == (("@/", "src/"),) and "tsconfig.json" in project.config_texts(str(tmp_path))


def test_fences():
    a = sinks.fenced("intro\n", "one")
    assert a.startswith("intro\n\n<!--") and sinks.fenced(sinks.fenced(a, "two"), "two").count("two") == 1 and sinks.fenced(a, None).strip() == "intro" and sinks.fenced("x", None) == "x"


def git(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_history_of_a_repository(spark, tmp_path):
    root = str(tmp_path)
    git(root, "init", "-q")
    for i in range(3):
        (tmp_path / "a.py").write_text(f"import os\nx = {i}\n" if i < 2 else "x = 2\n")
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / "sub/b.py").write_text(str(i))
        git(root, "add", "-A")
        git(root, "commit", "-qm", ["one", "two", "Remove os"][i])
    assert rows(cochange.file_counts(history.commit_files(spark, root))) == [("a.py", 3), ("sub/b.py", 3)]
    assert rows(history.commit_files(spark, f"{root}/sub").select("path").distinct()) == [("b.py",)]
    assert rows(cochange.removed_imports(history.diff_lines(spark, root)).select("message")) == [("Remove os",)]
    first = subprocess.run(["git", "-C", root, "rev-list", "--max-parents=0", "HEAD"], capture_output=True, text=True).stdout.strip()
    (tmp_path / "new.py").write_text("")
    assert history.changed_paths(root, first) == ["a.py", "new.py", "sub/b.py"] and history.changed_paths(root, "nope") is None
    assert history.hook(root, "strata ci") and not history.hook(root, "strata ci") and history.hook(root, "", remove=True)
    assert history.commit_files(spark, str(tmp_path.parent / "nowhere")) is None


def test_incremental(spark, tmp_path):
    f = lambda *x: spark.createDataFrame([(p, "python", False, c) for p, c in x], "path string, language string, is_support boolean, content string")
    one_, two = f(("a.py", "import x"), ("b.py", "y = 1"), ("gone.py", "")), f(("a.py", "import x"), ("b.py", "import z"), ("c.py", ""))
    first = incremental.refresh(one_, f"file://{tmp_path}/cache", "r1")
    assert first.count() == 3 and {r.path for r in incremental.changed(two, first).collect()} == {"b.py", "c.py"}
    second = incremental.refresh(two, f"file://{tmp_path}/cache", "r2")
    assert {r.path: [i.source for i in r.imports] for r in second.collect()} == {"a.py": ["x"], "b.py": ["z"], "c.py": []}
    assert incremental.refresh(two, f"file://{tmp_path}/cache", "r2").count() == 3


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda p, c: json.dumps({"path": p, "language": "python", "is_support": False, "content": c}) + "\n"
    (src / "1.json").write_text(line("a.py", "import x") + line("b.py", ""))
    s = spark.readStream.schema("path string, language string, is_support boolean, content string").option("maxFilesPerTrigger", 1).json(str(src))
    run = lambda: incremental.stream(s, f"file://{tmp_path}/cache").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    run()
    (src / "2.json").write_text(line("a.py", "import y"))
    run()
    assert {r.path: [i.source for i in r.imports] for r in spark.read.parquet(f"file://{tmp_path}/cache/batch-1").collect()} == {"a.py": ["y"], "b.py": []}


def test_module_ids(spark):
    got = one(spark, modules.module_id("p", ("src", "app")), ["src/a/x.ts", "src/x.ts", "be/app/m/u/v.py", "lib/z/q.ts", "top.ts", "app/src/k/z.ts"])
    assert got == ["src/a", "src", "app/m", "lib/z", ".", "app/src"]
