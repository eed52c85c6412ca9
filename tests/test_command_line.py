import json

from samples import TYPESCRIPT, write

from strataspark.__main__ import main


def run(capsys, spark, *argv):
    code = main(list(argv), spark)
    out = capsys.readouterr().out
    return code, json.loads(out) if out.strip() else None


def test_commands(capsys, spark, tmp_path):
    root = write(tmp_path, TYPESCRIPT)
    assert run(capsys, spark, "rules", root)[0] == 1
    code, health = run(capsys, spark, "init", root, "--no-history", "--agents")
    assert code == 0 and health["overall"] == 94 and (tmp_path / ".strata/config.json").exists() and "94/100" in (tmp_path / "AGENTS.md").read_text()
    assert len(run(capsys, spark, "rules", root, "--tier", "rule")[1]) == 2
    code, impact = run(capsys, spark, "impact", root, "src/db/index.ts")
    assert code == 0 and len(impact["dependents"]) == 3 and impact["module"] == [{"module": "src/db"}]
    assert run(capsys, spark, "show", root, "health")[1][0]["overall"] == 94
    bundle = run(capsys, spark, "show", root)[1]
    assert {"schema_version", "modules", "edges", "rules", "health", "parsing_stats"} <= set(bundle) and len(bundle["modules"]) == 5 and bundle["parsing_stats"][0]["ast_percent"] == 100
    assert len(run(capsys, spark, "show", root, "edges")[1]) == 15 and len(run(capsys, spark, "show", root, "edges", "--limit", "3")[1]) == 3
    (tmp_path / "src/models/user.ts").write_text("import { getConfig as load } from '../utils/config.js';\nexport const k = load();\n")
    code, changed = run(capsys, spark, "diff", root, "--no-history")
    assert code == 0 and {"change": "new", "src": "src/models/user.ts", "dst": "src/utils/config.ts"} in changed["edges"]
    code, gate = run(capsys, spark, "ci", root, "--no-history")
    assert code == 0 and gate["passed"]
    assert run(capsys, spark, "ci", write(tmp_path / "py", {"src/a.py": "def f(:\n"}), "--no-history", "--strict-ast")[0] == 1
