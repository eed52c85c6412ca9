"""The pipeline and the entry point on the smallest tables."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from strataspark.llm import decontaminate, langid, minhash

ROOT = Path(__file__).parents[2]
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == first.columns and out.dtypes == first.dtypes, name
        rows = out.collect()
        assert rows, name
        if name == "language":
            assert {r.doc_id for r in rows} == {r.doc_id for r in langid.identified(docs, *langid.training(docs)).where("keep").collect()}
        if name == "near_duplicates":
            gone = {r.doc_id for r in minhash.duplicates(docs).collect()}
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - gone and gone
        if name == "benchmark":
            found = {r.doc_id: r for r in decontaminate.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} - {i for i, r in found.items() if r.dropped}
            assert all(r.text == found[r.doc_id].clean_text and r.n_chars == len(r.text) for r in rows if r.doc_id in found)
        docs = spark.createDataFrame(rows, out.schema)
    assert len(rows) == corpus_pipeline.run(spark, DATA).count()
    assert sorted(r.position for r in rows) == list(range(1, len(rows) + 1))


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns named like those of the operators."""
    good = "the quick brown fox jumps over a lazy dog while many people watch from their houses near a river number "
    rows = [(i, good + " ".join(f"w{i}x{j}" for j in range(30)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, None, "en", "s0", 0), (101, "", "en", None, 0), (None, good + "alone here", "en", "s1", None), (102, "word " * 60_000 + "end", None, "s2", 9), (103, rows[0][1], "en", "s0", 1), (104, "!!!", "en", "s1", 3)]
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("position", "epoch", "__g", "keep", "component", "spans"):
        docs = docs.withColumn(c, F.concat(F.lit("mine-"), F.col("doc_id").cast("string")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(f"w7x{j}" for j in range(20))
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "shards":
            assert out.columns == docs.columns, name
        kept = out.collect()
        for r in kept:
            assert all(r[c] == (None if r.doc_id is None else f"mine-{r.doc_id}") for c in ("epoch", "__g", "keep", "component", "spans")), name
        now = spark.createDataFrame(kept, out.schema)
    ids = [r.doc_id for r in kept]
    assert len(set(ids) & set(range(30))) >= 25
    assert 103 not in ids and 100 not in ids and 101 not in ids
    assert all(item not in r.text for r in kept) and sorted(r.position for r in kept) == list(range(1, len(kept) + 1))


def test_entry():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(re.match(rf"op{n}_", q) for q in names)] == [] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    for p in [*(ROOT / "strataspark").rglob("*.py"), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]:
        if "llm" not in p.relative_to(ROOT).parts and p.exists():
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
    for p in (ROOT / "strataspark/llm").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text() and "except ImportError" not in p.read_text(), p
