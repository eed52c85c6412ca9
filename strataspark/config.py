"""Settings of a scan and the thresholds of its operators.

Every threshold is a field, so that small tests and derived tables can use values that select some rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

EXTENSIONS = {
    ".cjs": "javascript", ".cts": "typescript", ".go": "go", ".java": "java", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".mts": "typescript", ".py": "python", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript",
}


@dataclass(frozen=True)
class Thresholds:
    contract_confidence: float = 0.7
    contract_most: int = 50
    bulk_files: int = 20
    least_commits: int = 10
    chain_most: int = 10
    chain_least: int = 3
    fan_in_signal: int = 3
    busy_share: float = 0.3
    hot_most: int = 15
    spof: tuple[int, int, int] = (15, 25, 40)
    fan_out: tuple[int, int] = (8, 15)
    god_files: int = 15
    god_times: float = 3.0
    god_exports: tuple[int, int] = (50, 80)
    long_chain: tuple[int, int] = (5, 7)
    bottleneck_fan_in: int = 10
    bottleneck_most: int = 5
    cycles_most: int = 5
    hub: tuple[int, int] = (10, 8)
    core_fan_in: int = 3
    core_instability: float = 0.5
    hotspot: tuple[float, int] = (0.2, 5)
    hidden: float = 0.75
    hidden_most: int = 10
    exposed_least: int = 10
    concentration_files: int = 20
    concentration: tuple[float, float] = (0.5, 0.7)


@dataclass(frozen=True)
class Config:
    """Options of a scan. ``resolve_absolute`` also resolves imports that parity mode leaves unresolved: Go packages
    of the project, and absolute imports when module dependencies are derived. ``check_violations`` counts rule
    violations from the edges instead of the constant 0. Both are off by default."""

    languages: tuple[str, ...] = ("go", "java", "javascript", "python", "rust", "typescript")
    roots: tuple[str, ...] = ("src",)
    exclude: tuple[str, ...] = ("node_modules", "dist", "build", "target", "vendor", ".git")
    max_commits: int = 1000
    min_confidence: float = 0.7
    rule_overrides: dict[str, str] = field(default_factory=dict)
    resolve_absolute: bool = False
    check_violations: bool = False
    thresholds: Thresholds = Thresholds()


def load_config(path: str | Path | None, base: Config | None = None) -> Config:
    """Defaults overlaid shallowly by a JSON file; a missing or unreadable file gives the defaults."""
    base = base or Config()
    try:
        own = json.loads(Path(path).read_text()) if path else {}
    except (OSError, ValueError):
        return base
    known = {f.name for f in fields(Config)} - {"thresholds"}
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in known}
    return replace(base, **own)


def write_default_config(path: str | Path) -> bool:
    """Write the defaults where there is no file yet; tells whether it wrote."""
    path = Path(path)
    if path.exists():
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    d = Config()
    path.write_text(json.dumps({f.name: getattr(d, f.name) for f in fields(Config) if f.name != "thresholds"}, indent=2) + "\n")
    return True
