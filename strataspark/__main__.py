"""Command line: ``python -m strataspark COMMAND ROOT ...``.

``scan`` leaves a snapshot, JSON tables and a summary below ``ROOT/.strata``; the next scan takes trends from it, and
``diff`` compares with it. ``ci`` ends with 1 when a confident rule is violated or the scan fails.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.config import Config, load_config, write_default_config
from strataspark.operators import api, delta
from strataspark.plans.scan import scan_project
from strataspark.sources import history, sinks

AGENT_FILES = ("AGENTS.md",)
#: What ``show`` gives when no table is named.
BUNDLE = ("modules", "edges", "nodes", "rules", "contracts", "health", "parsing_stats")


def home(root: str) -> Path:
    return Path(root).resolve() / ".strata"


def last_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame] | None:
    marker = home(root) / "latest"
    return sinks.read_snapshot(spark, f"file://{home(root)}/snapshots/{marker.read_text().strip()}") if marker.exists() else None


def scanned(spark: SparkSession, args: argparse.Namespace) -> tuple[dict[str, DataFrame] | None, dict[str, DataFrame]]:
    """The snapshot before, and a new scan, which becomes the latest snapshot."""
    config = load_config(home(args.root) / "config.json")
    if args.roots:
        config = replace(config, roots=tuple(args.roots.split(",")))
    before = last_snapshot(spark, args.root)
    out = scan_project(spark, str(Path(args.root).resolve()), config, not args.no_history, before["rules"] if before else None, args.strict_ast, f"file://{home(args.root)}/cache")
    marker = home(args.root) / "latest"
    run = f"run-{int(marker.read_text().strip().split('-')[1]) + 1 if marker.exists() else 1:06d}"
    sinks.write_snapshot(out, f"file://{home(args.root)}/snapshots", run)
    marker.write_text(run)
    return before, out


def rows(df: DataFrame, most: int | None = None) -> list[dict]:
    """Rows for the terminal, all unless a limit is asked for; one that is cut off says so."""
    out = [json.loads(r) for r in (df if most is None else df.limit(most + 1)).toJSON().collect()]
    if most is not None and len(out) > most:
        print(f"cut off after {most} rows", file=sys.stderr)
        return out[:most]
    return out


def say(data: object) -> None:
    print(json.dumps(data, indent=2, sort_keys=True))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="strataspark")
    p.add_argument("command", choices=("init", "scan", "ci", "rules", "diff", "show", "impact", "hook"))
    p.add_argument("root")
    p.add_argument("what", nargs="?", help="table for show, file for impact")
    p.add_argument("--roots", help="comma-separated source roots")
    p.add_argument("--no-history", action="store_true")
    p.add_argument("--strict-ast", action="store_true")
    p.add_argument("--tier")
    p.add_argument("--min-confidence", type=float, default=0.8)
    p.add_argument("--limit", type=int, help="rows of each result; what is left out is told")
    p.add_argument("--agents", action="store_true", help="put the summary into context files")
    p.add_argument("--remove", action="store_true")
    args = p.parse_args(argv)
    if args.command == "hook":
        say({"changed": history.hook(args.root, "python -m strataspark ci .", args.remove)})
        return 0
    spark = spark or SparkSession.builder.appName("strataspark").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    if args.command == "init":
        write_default_config(home(args.root) / "config.json")
    if args.command in ("rules", "show", "impact"):
        now = last_snapshot(spark, args.root)
        if now is None:
            print("no snapshot; run scan first", file=sys.stderr)
            return 1
        if args.command == "rules":
            say(rows(api.get_rules(now["rules"], tier=args.tier), args.limit))
        elif args.command == "show":
            names = [args.what] if args.what else [n for n in BUNDLE if n in now]
            found = {n: rows(now[n], args.limit) for n in names}
            say(found[args.what] if args.what else {"schema_version": sinks.SCHEMA_VERSION, **found})
        else:
            members = now["modules"].select(F.col("id").alias("module"), F.explode("files").alias("path"))
            say({k: rows(v, args.limit) for k, v in api.check_impact(args.what, members, now["edges"], now["contracts"], now["chain_links"]).items()})
        return 0
    try:
        before, now = scanned(spark, args)
    except ValueError as e:
        if args.command != "ci":
            raise
        print(e, file=sys.stderr)
        return 1
    if args.command == "ci":
        found = api.violations(now["rules"], args.min_confidence).select("finding", "id", "tier", "confidence", "trend", "description").orderBy("finding", "id")
        ok = api.passes(now["rules"], args.min_confidence)
        say({"passed": ok, "findings": rows(found, args.limit)})
        return 0 if ok else 1
    if args.command == "diff":
        if before is None:
            print("no earlier snapshot", file=sys.stderr)
            return 1
        parts = {
            "edges": delta.delta_edges(before["edges"], now["edges"]), "modules": delta.delta_modules(before["modules"], now["modules"]),
            "risk": delta.delta_risk(before["file_risks"], now["file_risks"]), "rules": delta.delta_rules(before["rules"], now["rules"]),
        }
        say({k: rows(v, args.limit) for k, v in parts.items()})
        return 0
    sinks.write_json(now, str(home(args.root) / "json"))
    summary = sinks.markdown(now)
    (home(args.root) / "SUMMARY.md").write_text(summary)
    if args.agents:
        sinks.integrate(args.root, summary, AGENT_FILES)
    say(rows(now["health"])[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
