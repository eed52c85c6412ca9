"""Steps whose work must grow no faster than their input, and their results."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from strataspark.operators import cochange, graph, modules, resolve
from strataspark.plans import derived, queries, tables
from strataspark.sources import extract, history, parsers, tokens

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, name, data=DATA):
    if not Path(data).exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in got.collect())


def test_imports_of_one_directory_are_answered_once(spark):
    rows = [(f"src/a/f{i}.ts", "typescript", o, s, s.startswith(".")) for i in range(40) for o, s in enumerate(["./x", "../b/y", "@/b/y", "lib", "./none"])]
    imports = spark.createDataFrame(rows, "path string, language string, ord int, source string, is_relative boolean")
    files = spark.createDataFrame([("src/a/x.ts",), ("src/b/y.tsx",)], "path string")
    asked = imports.select(*resolve.request(F.lit("src/a"), "language", "is_relative", "source"))
    assert resolve.answers(asked, files, aliases=(("@/", "src/"),)).count() == 3
    got = {(r.path, r.source): r.target for r in resolve.resolved(imports, files, aliases=(("@/", "src/"),)).collect()}
    assert got == {(p, s): {"./x": "src/a/x.ts", "../b/y": "src/b/y.tsx", "@/b/y": "src/b/y.tsx"}.get(s) for p, _, _, s, _ in rows}


@pytest.mark.parametrize("language", ["typescript", "python", "rust", "java", "go"])
def test_resolution_asks_by_directory(spark, language):
    """Import sources are exploded before customers are joined only for nations and suppliers: the last step is one explode of arrays."""
    if not Path(DATA).exists():
        pytest.skip("no tables")
    plan = queries.QUERIES[f"resolve_{language}"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("orders.parquet") + plan.count("[o_orderkey") <= 2 and plan.count("Relation [o_orderkey") == 1
    same_as_sql(spark, f"resolve_{language}")


@pytest.mark.parametrize("language", ["python", "rust", "java", "typescript", "go"])
def test_lines_meet_answers_in_two_shuffles(spark, tmp_path, language):
    """By order and by what answers are kept by; customers and suppliers that are there twice count twice."""
    if not Path(DATA).exists():
        pytest.skip("no tables")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[f"resolve_{language}"](spark, DATA)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
    i = next(k for k, x in enumerate(plan) if "FileScan parquet [l_orderkey" in x)
    depth, above = at(plan[i]), []
    for x in plan[i::-1]:
        if at(x) < depth:
            depth = at(x)
            above.append(x)
    assert sum(" Exchange " in x for x in above) == 2
    assert sum("REPARTITION_BY_NUM" in x and "hashpartitioning(s#" in x for x in plan) >= 1  # suppliers are made requests of in many tasks
    for f in Path(DATA).glob("*.parquet"):
        twice = f.stem in ("customer", "supplier")
        duckdb.execute(f"COPY (SELECT * FROM '{f}'{f""" UNION ALL (SELECT * FROM '{f}' LIMIT 3)""" * twice}) TO '{tmp_path}/{f.name}'")
    same_as_sql(spark, f"resolve_{language}", tmp_path)


@pytest.mark.parametrize("language", ["rust", "java", "go", "typescript", "python"])
def test_files_are_parsed_once(spark, language):
    if not Path(DATA).exists():
        pytest.skip("no tables")
    plan = queries.QUERIES[f"code_{language}"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    same_as_sql(spark, f"code_{language}")


@pytest.mark.parametrize("language", ["java", "go", "typescript", "python", "rust"])
def test_texts_are_written_where_they_are_parsed(spark, language):
    """Keys of lines are shuffled once, and texts never."""
    if not Path(DATA).exists():
        pytest.skip("no tables")
    plan = queries.QUERIES[f"code_{language}"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if " Exchange " in x]
    assert len(shuffles) == 1 and "hashpartitioning(p_partkey" in shuffles[0] and "REPARTITION_BY_NUM" in shuffles[0]


def test_lexer_on_letters_blanks_and_marks():
    t = tokens.tokens("a\u00e9b $\u00e9 r1\f = (x\u20ac y]\r\n \t\u00a0z / 2 `q`", tokens.SCRIPT)
    assert list(zip(t.code, t.line, t.depth, t.indent)) == [("a\u00e9b", 1, 0, 0), ("$\u00e9", 1, 0, -1), ("r1", 1, 0, -1), ("=", 1, 0, -1), ("(", 1, 0, -1), ("x", 1, 1, -1), ("\u20ac", 1, 1, -1), ("y", 1, 1, -1), ("]", 1, 1, -1), ("z", 2, 1, 3), ("/", 2, 1, -1), ("", 2, 1, -1), ("", 2, 1, -1)]
    assert t.broken and t.closing(4) == len(t) and t.find("y", 0) == 7 and t.find("y", 0, 3) == 3


def test_batches_of_more_than_a_slice(spark):
    rows = [(f"f{i}.ts", "typescript", False, None if i % 7 == 0 else f"import {{ a{i} }} from './b{i}'\n" * (i % 3)) for i in range(1201)]
    got = extract.parsed(spark.createDataFrame(rows, "path string, language string, is_support boolean, content string").coalesce(1)).collect()
    assert [(r.path, [(x.source, x.specifiers, x.line) for x in r.imports], r.exports) for r in got] == [(f"f{i}.ts", [(f"./b{i}", [f"a{i}"], n + 1) for n in range(i % 3 if i % 7 else 0)], []) for i in range(1201)]


def test_parse_methods_need_no_statements(spark, monkeypatch):
    texts = [(l, x) for l in ("typescript", "python", "go", "rust", "java", "cobol") for x in ("", "a = (1)\n", "a = (\n", "/* open", '"""x', "def f(:\n")] + [("go", None)]
    files = spark.createDataFrame([(str(i), l, False, x) for i, (l, x) in enumerate(texts)], "path string, language string, is_support boolean, content string")
    want = {str(i): parsers.parse(x, l)[0] for i, (l, x) in enumerate(texts)}
    assert {r.path: r.parse_method for r in extract.methods(files).collect()} == want
    monkeypatch.setattr(parsers, "READERS", dict.fromkeys(parsers.READERS))
    assert [parsers.parse_method(x, l) for l, x in texts] == list(want.values())


def test_containing_is_brute_force_on_random_paths(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
    files = sorted({"/".join(word() for _ in range(rng.randrange(1, 6))) + rng.choice([".java", ""]) for _ in range(150)})
    parts = sorted({"/".join(word() for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", "/"]) for _ in range(150)})
    wanted = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, part string")
    for java in (True, False):
        pool = [x for x in files if x.endswith(".java") or not java]
        want = {i: min(x for x in pool if p in x) for i, p in enumerate(parts) if any(p in x for x in pool)}
        assert {r.i: r.target for r in resolve._containing(wanted, spark.createDataFrame([(x,) for x in files], "path string"), java).collect()} == want


def test_metrics_count_distinct_keys_in_one_shuffle(spark, tmp_path):
    lines = [(1, 10, 5, "R"), (1, 10, 5, "N"), (1, 11, 5, "R"), (1, None, 6, "N"), (2, None, None, "N"), (2, 12, 7, None)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 2, "PROMO", "a b"), (2, 1, "SMALL", "c d"), (3, 1, "SMALL", "e")], "p_partkey long, p_size int, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    m = derived.metrics(derived.Tables(spark, str(tmp_path)))
    assert {r.file: (r.fan_in, r.transitive_impact, r.change_frequency) for r in m.collect()} == {"promo/api/a_b_1.py": (2, 2, 0.5), "small/api/c_d_2.py": (1, 1, 0.0)}
    assert "Expand" not in m._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, "file_risk")


def test_modules_of_edges_are_reduced_before_their_targets_are_looked_up(spark):
    members = spark.createDataFrame([("A", "a.py"), ("A", "b.py"), ("B", "c.py"), ("C", "d.py")], "module string, path string")
    edges = spark.createDataFrame([("a.py", "c.py"), ("a.py", "c.py"), ("b.py", "c.py"), ("a.py", "b.py"), ("d.py", "a.py"), ("b.py", "none.py")], "src string, dst string")
    imports = spark.createDataFrame([("a.py", True), ("a.py", True), ("b.py", True), ("d.py", False)], "path string, is_relative boolean")
    found = modules.module_deps(members, edges, imports)
    assert found.collect() == [("A", "B")]
    assert sorted(modules.module_deps(members, edges, imports, True).collect()) == [("A", "B"), ("C", "A")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [module") == 2
    same_as_sql(spark, "module_deps")


def test_hot_files_without_multiplied_lines(spark):
    if not Path(DATA).exists():
        pytest.skip("no tables")
    assert "Expand" not in queries.QUERIES["hot_files"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, "hot_files")


@pytest.mark.parametrize("name", ["hot_files", "file_risk", "insights_dedup"])
def test_metrics_are_computed_once_in_tasks_of_a_given_size(spark, monkeypatch, name):
    if not Path(DATA).exists():
        pytest.skip("no tables")
    monkeypatch.setattr(tables, "SHARE", 500)
    t = derived.Tables(spark, DATA)
    plan = derived.metrics(t)._jdf.queryExecution().executedPlan().toString()
    shares = -(-t.lineitem.count() // 500)
    assert [x for x in plan.splitlines() if "hashpartitioning(l_partkey" in x and f", {shares}), REPARTITION_BY_NUM" in x] and shares > 4
    assert "Window" not in queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    same_as_sql(spark, name)


def counted(spark, rows, schema):
    """A table that tells how many rows were computed of it, all times together."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, schema)
    return df.mapInArrow(passed, df.schema), seen


#: Wide and shallow, with a pair twice, a circle, a node that uses itself, and nodes that lead to these.
WIDE = [(f"p{i}", f"s{i * k % 7}") for i in range(40) for k in (1, 2, 3)] + [(f"s{i}", f"n{i % 3}") for i in range(7)] + [("n0", "r"), ("n1", "r"), ("n2", "r"), ("p1", "s1"), ("q", "c1"), ("c1", "c2"), ("c2", "c1"), ("c2", "p3"), ("x", "x"), ("y", "r"), ("z", "y")]
RUNS = {
    "critical_paths": lambda e: graph.critical_paths(e, 12, 2),
    "longest_chains": graph.longest_chains,
    "transitive_impact": graph.transitive_impact,
    "layers": lambda e: graph.layers(None, e),
}


@pytest.mark.parametrize("name", RUNS)
def test_edges_are_computed_once(spark, monkeypatch, name):
    few = sorted(map(str, RUNS[name](spark.createDataFrame(WIDE, "src string, dst string")).collect()))
    monkeypatch.setattr(graph, "LOCAL_EDGES", -1)
    for chosen in (WIDE, [x for x in WIDE if x[0][0] in "psnyz"], [x for x in WIDE if x[0][0] == "n"]):  # with and without circles, wide at either end
        e, seen = counted(spark, chosen, "src string, dst string")
        got = sorted(map(str, RUNS[name](e).collect()))
        assert seen.value == len(chosen)
        if chosen is WIDE:
            assert got == few


@pytest.mark.parametrize("name", ["ins_long_chain", "longest_chain_length", "critical_paths", "transitive_impact", "parse_log", "ins_dead_module", "ins_hub", "topo_layers", "ins_hidden_coupling", "co_change_contracts"])
def test_mended_queries_are_as_their_sql(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "LOCAL_EDGES", -1)
    monkeypatch.setattr(tables, "SHARE", 500)
    same_as_sql(spark, name)


def test_dead_modules_compute_edges_once(spark, monkeypatch):
    e, seen = counted(spark, sorted(set(WIDE)), "src string, dst string")
    monkeypatch.setattr(derived, "edges", lambda t: e)
    got = queries.QUERIES["ins_dead_module"](spark, DATA)
    assert {r.id for r in got.collect()} == {f"dead-module:{x}" for x in ("p0", "p7", "p14", "p21", "p28", "p35", "q", "z")}
    assert seen.value == len(set(WIDE))
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString() and got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3


def test_contracts_gather_commits_once(spark):
    log = [(f"h{i}", p) for i in range(60) for p in ("a/x.py", "b/y.py", "b/y.py", "c/z.txt", *[f"d/{i % 4}.py"] * (i % 2))]
    commits, seen = counted(spark, log, "hash string, path string")
    got = {(r.file_a, r.file_b): (r.occurrences, round(r.confidence, 4)) for r in cochange.contracts(commits, 0.2).collect()}
    assert got == {("a/x.py", "b/y.py"): (60, 1.0), ("a/x.py", "d/1.py"): (15, 0.25), ("a/x.py", "d/3.py"): (15, 0.25), ("b/y.py", "d/1.py"): (15, 0.25), ("b/y.py", "d/3.py"): (15, 0.25)}
    assert seen.value == len(log)


def test_logs_lie_in_as_many_partitions_as_their_lines_ask_for(spark, monkeypatch):
    monkeypatch.setattr(tables, "SHARE", 50)
    rows = [(k, i, x) for k in range(100) for i, x in enumerate([f"{k:040x}", "1\t2\tapp/a.py", "", "1\t2\tapp/a.py", "1\t2\tout.py", "no"])]
    got = history.parse_log(spark.createDataFrame(rows, "k int, ord int, line string"), "app/", by="k")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(got.select("hash", "path").collect()) == [(f"{k:040x}", "a.py") for k in range(100)]
    assert got.rdd.getNumPartitions() == 12


@pytest.mark.parametrize("inner", [0, 10**6])
def test_only_edges_between_used_nodes_take_part_in_the_rounds(spark, monkeypatch, inner):
    """Whether these are walked in loops or in memory, and whatever edges hold for nodes."""
    rng = random.Random(5)
    pairs = [(a, b) for a in range(30) for b in range(30) if rng.random() < 0.04] + [(40 + i, rng.randrange(30)) for i in range(90)] + [(40, 1), (40, 1), (None, 3), (3, None)]
    coded = spark.createDataFrame([(a if a is None else (a,), b if b is None else (b,)) for a, b in pairs], "src struct<key: int>, dst struct<key: int>")
    name = lambda node: F.concat(F.lit("n"), node["key"].cast("string"))
    named = coded.select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"))
    want = sorted(map(str, graph.critical_paths(named, 50, 2).collect())), sorted(map(str, graph.longest_chains(named).collect()))
    monkeypatch.setattr(graph, "LOCAL_EDGES", 1)
    monkeypatch.setattr(graph, "INNER", inner)
    seen, peeled = [], graph._peeled
    monkeypatch.setattr(graph, "_peeled", lambda nodes, waits, what: seen.append(waits.count()) or peeled(nodes, waits, what))
    assert sorted(map(str, graph.critical_paths(coded, 50, 2, name).collect())) == want[0] and len(want[0]) == 50
    assert sorted(map(str, graph.longest_chains(named).collect())) == want[1]
    whole = [(a, b) for a, b in pairs if None not in (a, b)]
    assert seen == ([] if inner else [sum(a in {b for _, b in whole} for a, _ in whole)] * 2)
    assert graph.critical_paths(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")).collect() == []


def test_links_of_lines_are_not_shuffled(spark, monkeypatch):
    if not Path(DATA).exists():
        pytest.skip("no tables")
    t = derived.Tables(spark, DATA)
    assert "Exchange" not in derived.links(t)._jdf.queryExecution().executedPlan().toString()
    assert sorted(derived.named_links(t).distinct().collect()) == sorted(derived.edges(t).select("src", "dst").collect())
    monkeypatch.setattr(graph, "LOCAL_EDGES", 500)
    for name in ("critical_paths", "ins_long_chain", "longest_chain_length"):
        same_as_sql(spark, name)
