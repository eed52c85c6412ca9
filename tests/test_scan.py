import pytest
from samples import GO, PYTHON, TYPESCRIPT, write

from strataspark.config import Config
from strataspark.plans.scan import scan_project
from strataspark.sources import sinks

METRICS = {
    "src/utils/config.ts": (2, 9, True, 100, "critical"), "src/db/connection.ts": (2, 7, True, 87, "critical"), "src/db/index.ts": (3, 5, True, 78, "critical"), "src/db/users.ts": (1, 6, True, 76, "critical"),
    "src/auth/middleware.ts": (1, 4, True, 63, "high"), "src/auth/index.ts": (2, 3, True, 61, "high"), "src/routes/users.routes.ts": (1, 1, True, 43, "medium"), "src/auth/jwt.ts": (2, 5, False, 41, "medium"),
    "src/routes/index.ts": (0, 0, True, 33, "medium"), "src/routes/auth.routes.ts": (1, 1, False, 11, "low"), "src/models/user.ts": (0, 0, False, 0, "low"),
}
RULES = {
    ("auth", "db"): ("observation", 0.65), ("auth", "models"): ("convention", 0.5), ("auth", "utils"): ("observation", 0.65), ("db", "models"): ("rule", 0.5875), ("db", "utils"): ("observation", 0.65),
    ("models", "routes"): ("rule", 0.641667), ("models", "utils"): ("observation", 0.35), ("routes", "utils"): ("convention", 0.5), ("auth", "routes"): ("observation", 0.55), ("auth",): ("observation", 0.55),
    ("db",): ("observation", 0.55), ("models",): ("observation", 0.55), ("utils",): ("observation", 0.55), ("routes",): ("convention", 0.583333),
}


@pytest.fixture(scope="module")
def ts(spark, tmp_path_factory):
    root = write(tmp_path_factory.mktemp("ts"), TYPESCRIPT | {"node_modules/x/index.js": "export const no = 1\n", "tests/db/users.txt": ""})
    return {k: v for k, v in scan_project(spark, root, Config(), use_history=False).items()}


def test_edges(ts):
    got = {(r.src, r.dst): r for r in ts["edges"].collect()}
    assert len(got) == 15
    assert got["src/auth/index.ts", "src/auth/jwt.ts"].weight == 2
    assert [x.symbol for x in got["src/auth/index.ts", "src/auth/jwt.ts"].refs] == ["verifyToken", "JWTPayload"]
    assert {r.id for r in ts["nodes"].where("type = 'external'").collect()} == {"ext:jsonwebtoken", "ext:express"}


def test_metrics(ts):
    got = {r.file: (r.fan_in, r.transitive_impact, r.on_critical_path, r.score, r.risk) for r in ts["file_risks"].collect()}
    assert got == METRICS
    hot = [(r.file, r.importance) for r in ts["hot_files"].collect()]
    assert hot[0] == ("src/utils/config.ts", 13.0) and len(hot) == 10 and dict(hot)["src/auth/jwt.ts"] == 9.0


def test_longest_chain(ts):
    (p,) = ts["critical_paths"].collect()
    assert p.length == 8 and p.root_file == "src/utils/config.ts" and p.leaf_file == "src/routes/index.ts"
    assert p.files == [f"src/{x}.ts" for x in ("routes/index", "routes/users.routes", "auth/index", "auth/middleware", "db/index", "db/users", "db/connection", "utils/config")]


def test_modules(ts):
    got = {r.id: (len(r.files), r.n_exports, r.internal_deps) for r in ts["modules"].collect()}
    assert got == {"src/auth": (3, 4, ["src/db", "src/utils"]), "src/db": (3, 3, ["src/utils"]), "src/models": (1, 2, []), "src/routes": (3, 2, ["src/auth", "src/db"]), "src/utils": (1, 1, [])}
    assert {r.module: r.level for r in ts["layers"].collect()} == {"src/auth": 2, "src/db": 3, "src/models": 1, "src/routes": 1, "src/utils": 4}


def test_rules(ts):
    rows = ts["rules"].collect()
    got = {tuple(sorted(s.split("/")[-1] for s in r.scope)): (r.tier, round(r.confidence, 6)) for r in rows}
    assert got == RULES
    assert {r.id for r in rows} >= {"boundary-001", "layer-004", "layer-006", "naming-013", "boundary-014"}
    assert ts["signals"].count() == 20
    assert tuple(ts["pattern"].first()) == ("clean-architecture", 0.75)


def test_insights_and_health(ts):
    got = sorted((r.severity, r.metric) for r in ts["insights"].collect())
    assert got.count(("warning", "untested-high-risk")) == 6 and ("warning", "long-dependency-chain") in got and ("info", "dead-module") in got and ("info", "orphan-endpoint") in got and len(got) == 9
    assert ts["health"].first().overall == 94
    assert {r.module.split("/")[1]: r.score for r in ts["module_scores"].collect()} == {"auth": 98, "db": 97, "models": 100, "routes": 100, "utils": 98}
    assert ts["chain_links"].count() == 0 and ts["parsing_stats"].first().files == 11


def test_sinks(ts, spark, tmp_path):
    text = sinks.markdown(ts)
    assert "94/100" in text and "src/utils/config.ts" in text
    base = sinks.write_snapshot(ts, f"file://{tmp_path}/snap", "run1")
    back = sinks.read_snapshot(spark, base)
    assert back["edges"].count() == 15 and set(back) == set(sinks.TABLES)
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, f"file://{tmp_path}/none")
    assert "rules" in sinks.write_json(ts, str(tmp_path / "json")) and (tmp_path / "json/manifest.json").exists()
    assert sinks.integrate(str(tmp_path), text, ("AGENTS.md",)) == ["AGENTS.md"] and sinks.integrate(str(tmp_path), text, ("AGENTS.md",)) == []


def test_python_project(spark, tmp_path):
    got = scan_project(spark, write(tmp_path / "p", PYTHON), Config(roots=("app",)), use_history=False)
    assert got["edges"].count() == 6 and {r.name for r in got["modules"].collect()} == {"auth", "models", "services", "utils"}
    assert all(r.internal_deps == [] and r.language == "python" for r in got["modules"].collect())
    assert got["parsing_stats"].first().ast_percent == 100
    fixed = scan_project(spark, write(tmp_path / "q", PYTHON | {"app/__init__.py": ""}), Config(roots=("app",), resolve_absolute=True), use_history=False)
    assert {r.id: r.internal_deps for r in fixed["modules"].collect()}["app/services"] == ["app/auth", "app/models"]


def test_go_project(spark, tmp_path):
    root = write(tmp_path / "g", GO | {"go.mod": "module github.com/example/myapp\n"})
    got = scan_project(spark, root, Config(roots=("cmd", "pkg")), use_history=False)
    assert got["edges"].count() == 0
    assert {r.id for r in got["nodes"].where("type = 'external'").collect()} == {"ext:fmt", "ext:net", "ext:crypto", "ext:encoding", "ext:database"}
    names = {r.name for r in got["module_exports"].collect()}
    assert names >= {"Token", "Verify", "Sign", "Secret"} and "internalHelper" not in names
    fixed = scan_project(spark, root, Config(roots=("cmd", "pkg"), resolve_absolute=True), use_history=False)
    assert {(r.src, r.dst) for r in fixed["edges"].collect()} == {("cmd/main.go", "pkg/auth/auth.go"), ("cmd/main.go", "pkg/handlers/router.go"), ("pkg/handlers/router.go", "pkg/auth/auth.go"), ("pkg/handlers/router.go", "pkg/db/db.go")}


def test_parse_cache(spark, tmp_path, monkeypatch):
    """What is as it was isn't parsed again; results are those of a whole scan."""
    from strataspark.sources import extract
    from strataspark.streaming import incremental

    root, cache = write(tmp_path / "p", TYPESCRIPT), f"file://{tmp_path}/cache"
    first = scan_project(spark, root, Config(), use_history=False, cache=cache)
    assert first["edges"].count() == 15
    (tmp_path / "p/src/models/user.ts").write_text("import {\n  getConfig,\n} from '../utils/config.js';\nexport const k = getConfig();\n")
    (tmp_path / "p/src/routes/index.ts").unlink()
    asked = []
    monkeypatch.setattr(incremental, "parsed", lambda files: asked.append(sorted(r.path for r in files.select("path").collect())) or extract.parsed(files))
    again = scan_project(spark, root, Config(), use_history=False, cache=cache)
    assert asked == [["src/models/user.ts"]]
    whole = scan_project(spark, root, Config(), use_history=False)
    key = lambda out, t: sorted(map(str, out[t].drop("refs").collect()))
    assert all(key(again, t) == key(whole, t) for t in ("edges", "modules", "file_risks", "parsing_stats"))
    assert len([p for p in (tmp_path / "cache").glob("parsers-*/scan-*")]) == 2
