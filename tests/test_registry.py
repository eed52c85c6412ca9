"""The registered queries: their SQL binds to the driver's tables, and files that rest on project paths behave."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strataspark.operators import resolve, rules
from strataspark.plans import queries
from strataspark.sources import files
from strataspark.plans.tables import cut, light_session, ordinal

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_sql_binds():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, sql in queries.ORACLES.items():
        con.execute(f"EXPLAIN {sql}")
        assert name in queries.QUERIES
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and not set(queries.QUERIES) - set(queries.ORACLES)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["code_typescript", "resolve_java", "module_rows", "health_overall", "rule_texts", "check_impact"])
def test_queries_are_their_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in got.collect()) and set(names) == set(got.columns)


def test_containing_is_brute_force(spark):
    files = ["com/ab/Cd.java", "com/abc/x/Y.java", "org/com/ab.java", "zz.java", "a/b.txt", "comx/ab/Z.java"]
    parts = ["com", "om/ab", "com/ab/C", "b", "zz", "", "nothing", "com/abc/x", "/", "x/Y.jav", "a/b"]
    f = spark.createDataFrame([(x,) for x in files], "path string")
    wanted = spark.createDataFrame([(str(i), i, p) for i, p in enumerate(parts)], "path string, ord int, part string")
    for java in (True, False):
        pool = [x for x in files if x.endswith(".java") or not java]
        want = {i: min(x for x in pool if p in x) for i, p in enumerate(parts) if any(p in x for x in pool) and p != "/"}
        got = {r.ord: r.target for r in resolve._containing(wanted, f, java).collect() if parts[r.ord] != "/"}
        assert got == want


@pytest.mark.parametrize("text,ids", [
    ("rules:\n  - description: a\n    scope: [x, y]\n  - just text\n  - description: b\n    scope: z\n", [["x", "y"], ["z"]]), ("- description: a\n", [["*"]]), ("a: [unclosed", []), ("rules: 7", []), ("just text", []), ("", []), ("\t- x: {", []),
])
def test_manual_rules_of_odd_files(spark, tmp_path, text, ids):
    p = tmp_path / "rules.yml"
    p.write_text(text)
    assert [r.scope for r in rules.manual_rules(spark, p).orderBy("id").collect()] == ids
    assert rules.manual_rules(spark, tmp_path / "none.yml").count() == 0


def test_light_session_leaves_the_shared_one_alone(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    light = light_session(spark)
    df = light.createDataFrame([(i, [str(i)], None) for i in range(5)], "a int, b array<string>, c double")
    assert cut(df, "x").collect() == df.collect() and cut(df, "x").schema == df.schema
    assert {k: spark.conf.get(k) for k in before} == before and light.conf.get("spark.sql.shuffle.partitions") == "2"
    assert [r.ordinal for r in ordinal(spark.range(7).select((F.col("id") % 2).alias("m"), "id"), ["m"], ["id"]).orderBy("m", "id").collect()] == list(range(1, 8))


def test_executors_list_what_the_driver_lists(spark, tmp_path):
    for name in ("a.py", "__init__.py", "sub/deep/er/b.TS", "sub/c.txt", ".hidden/d.py", "sub/.e.py", "node_modules/x/f.js", "sub/build/g.js", "sub/none/"):
        p = tmp_path / name
        (p if name.endswith("/") else p.parent).mkdir(parents=True, exist_ok=True)
        if not name.endswith("/"):
            p.write_text("x")
    got = sorted(r.path for r in files.walked(spark, f"file://{tmp_path}", directories_per_task=1).collect())
    assert got == files.listing(str(tmp_path)) == ["__init__.py", "a.py", "sub/deep/er/b.TS"]
    assert files.walked(spark, f"file://{tmp_path}/sub/none").count() == 0 and files.opened("s3a://bucket/x?region=eu-west-1")[1] == "bucket/x"
