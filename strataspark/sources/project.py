"""Settings of the scanned project: few small files at its root, read on the driver."""

from __future__ import annotations

import json
import posixpath
import re
from pathlib import Path

from strataspark.operators.signals import ESLINT


def _text(path: Path) -> str:
    try:
        return path.read_text()
    except (OSError, ValueError):
        return ""


def go_module(root: str) -> str:
    m = re.search(r"^module\s+(.+)$", _text(Path(root) / "go.mod"), re.M)
    return m[1].strip() if m else ""


def aliases(root: str) -> tuple[tuple[str, str], ...]:
    """(prefix, target) of the path aliases, each with its first target; broken files have none."""
    out = []
    for name in ("tsconfig.json", "jsconfig.json"):
        try:
            options = json.loads(_text(Path(root) / name) or "{}").get("compilerOptions") or {}
        except (ValueError, AttributeError):
            continue
        for alias, targets in (options.get("paths") or {}).items():
            if isinstance(targets, list) and targets:
                tail = "/" if targets[0].replace("*", "", 1).endswith("/") else ""
                out.append((alias.replace("*", "", 1), posixpath.normpath(posixpath.join(options.get("baseUrl", "."), targets[0].replace("*", "", 1))) + tail))
    return tuple(out)


def config_texts(root: str) -> dict[str, str]:
    names = (*ESLINT, "tsconfig.json", "package.json")
    return {n: t for n in names if (t := _text(Path(root) / n))}
