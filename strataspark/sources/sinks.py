"""What a scan leaves: tables, a summary in Markdown, and blocks in files for agents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.operators import insights as ins

SCHEMA_VERSION = 2
TABLES = ("modules", "edges", "nodes", "layers", "rules", "contracts", "file_risks", "critical_paths", "chain_links", "insights", "health", "module_scores", "hot_files", "parsing_stats", "parsed")


def write_snapshot(result: dict[str, DataFrame], path: str, run: str) -> str:
    """Each table as Parquet below ``path/run``; readers see a run when its manifest is there."""
    base = f"{path.rstrip('/')}/{run}"
    for name in TABLES:
        if name in result:
            result[name].write.mode("overwrite").parquet(f"{base}/{name}")
    spark = next(iter(result.values())).sparkSession
    spark.createDataFrame([(SCHEMA_VERSION, run)], "schema_version int, run string").coalesce(1).write.mode("overwrite").json(f"{base}/manifest")
    return base


def read_snapshot(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Tables of a snapshot; FileNotFoundError without one, ValueError for one of a later version."""
    try:
        version = spark.read.schema("schema_version int, run string").json(f"{base}/manifest").first().schema_version
    except Exception as e:
        raise FileNotFoundError(f"no snapshot at {base}") from e
    if version > SCHEMA_VERSION:
        raise ValueError(f"snapshot of version {version}")
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{base}/{name}")
        except Exception:  # a table that this run didn't write
            continue
    return out


def write_json(result: dict[str, DataFrame], directory: str) -> list[str]:
    """Pretty JSON files of the small result tables, for readers without Spark; ``parsed`` isn't among them."""
    Path(directory).mkdir(parents=True, exist_ok=True)
    names = [n for n in TABLES if n in result and n != "parsed"]
    for name in names:
        rows = [json.loads(x) for x in result[name].toJSON().collect()]
        (Path(directory) / f"{name}.json").write_text(json.dumps(rows, indent=2, sort_keys=True) + "\n")
    manifest = {"schemaVersion": SCHEMA_VERSION, "tables": names}
    (Path(directory) / "manifest.json").write_text(json.dumps(manifest, indent=2) + "\n")
    return names


BUDGETS = {"hot": 15, "chains": 10, "contracts": 20, "paths": 5, "warning": 10, "info": 5}


def markdown(result: dict[str, DataFrame], budgets: dict[str, int] = BUDGETS) -> str:
    """The summary; every list but modules, rules of the first tier and critical insights has a budget of rows."""
    b = {**BUDGETS, **budgets}
    out = ["# Architecture", ""]
    h = result["health"].first()
    out += [f"Health: **{h.overall}/100** ({h.trend})", "", "## Hot files", ""]
    out += [f"- `{r.file}` — {r.risk}, {r.fan_in} direct, {r.transitive_impact} in all" for r in result["hot_files"].orderBy(F.desc("importance"), "file").limit(b["hot"]).collect()]
    out += ["", "## Modules", ""]
    out += [f"- **{r.id}** ({r.language}): {len(r.files)} files, {r.n_exports} exports" + (f"; uses {', '.join(r.internal_deps)}" if r.internal_deps else "") for r in result["modules"].orderBy("id").collect()]
    rules = result["rules"]
    out += ["", "## Rules", ""]
    out += [f"- MUST `{r.id}` {r.description} {r.action}" for r in rules.where("tier = 'rule'").orderBy(F.desc("confidence"), "id").collect()]
    out += [f"- SHOULD `{r.id}` {r.description}" for r in rules.where("tier = 'convention'").orderBy(F.desc("confidence"), "id").limit(b["contracts"]).collect()]
    out += ["", "## Chains", ""]
    from strataspark.operators.chains import chains

    out += [f"- {r.resource}: {' → '.join(r.files)}" for r in chains(result["chain_links"]).orderBy(F.desc("links"), "resource").limit(b["chains"]).collect()]
    out += ["", "## Files that change together", ""]
    out += [f"- `{r.file_a}` and `{r.file_b}` ({r.confidence:.0%})" for r in result["contracts"].orderBy(F.desc("confidence"), "file_a", "file_b").limit(b["contracts"]).collect()]
    out += ["", "## Longest chains of dependencies", ""]
    out += [f"- {' → '.join(r.files)}" for r in result["critical_paths"].orderBy(F.desc("length"), "leaf_file").limit(b["paths"]).collect()]
    out += ["", "## Insights", ""]
    for severity in ("critical", "warning", "info"):
        rows = ins.ordered(result["insights"].where(F.col("severity") == severity))
        rows = rows if severity == "critical" else rows.limit(b[severity])
        out += [f"- {severity}: {r.description} {r.action}" for r in rows.collect()]
    return "\n".join(out) + "\n"


def fenced(text: str, block: str | None, begin: str = "<!-- strata begin -->", end: str = "<!-- strata end -->") -> str:
    """``text`` with the block between two marks put in, replaced, or (None) taken out; the rest stays."""
    head, found, rest = text.partition(begin)
    if found:
        tail = rest.partition(end)[2]
        if block is None:
            return head.rstrip("\n") + ("\n" if head.strip() else "") + tail.lstrip("\n")
        return f"{head}{begin}\n{block.rstrip()}\n{end}{tail}"
    if block is None:
        return text
    return (text.rstrip("\n") + "\n\n" if text.strip() else "") + f"{begin}\n{block.rstrip()}\n{end}\n"


def integrate(directory: str, summary: str, names: tuple[str, ...]) -> list[str]:
    """Upsert the summary into context files below ``directory``; gives those that changed."""
    changed = []
    for name in names:
        path = Path(directory) / name
        before = path.read_text() if path.exists() else ""
        after = fenced(before, summary)
        if after != before:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(after)
            changed.append(name)
    return changed
