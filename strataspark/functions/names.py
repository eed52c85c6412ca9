"""Resource names and roles of files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, col, stem

#: Roles in the order of a chain, and the path fragments that tell them; they are tried in order of ``rank``.
ROLES = ("model", "schema", "migration", "service", "api", "hook", "store", "page", "component", "test")
_FRAGMENTS = (
    ("model", "/(entities|models?)/"),
    ("schema", "/(dto|schemas?)/"),
    ("service", "/(usecases|services?)/"),
    ("api", "/(handlers|controllers|routes|api)/"),
    ("hook", "/hooks/"),
    ("page", "/(screens|views|pages)/"),
    ("component", "/components/"),
    ("store", "/stores?/"),
    ("test", "/test|__test"),
    ("migration", None),
)
_STOP = frozenset("__init__ app config conftest constants env helpers index lib main mod setup types utils".split())
_STOP_CHAINS = _STOP | frozenset("auth connection database logger middleware router theme".split())
_VERB = r"(?i)^(create|delete|fetch|get|patch|post|put|update|use)"
_PARTS = "Api|Client|Component|Controller|Factory|Handler|Hook|Manager|Model|Module|Page|Provider|Repository|Resolver|Router|Routes?|Schema|Service|Store|View"
_SNAKE = r"(?i)(_(controller|handler|model|repository|routes?|schema|service|test)|\.(spec|test))$"


def resource_name(path: Column | str, chains: bool = True) -> Column:
    """The thing that a file is about, or null: base name without verb, role and plural.

    ``chains``: the longer list of names that stand for nothing, and ``Layout`` as a role, as resource chains have it; cross-stack signals use the shorter one.
    """
    name = stem(path)
    core = F.regexp_replace(name, _VERB, "")
    core = F.regexp_replace(core, f"(?i)({_PARTS}{'|Layout' if chains else ''})$", "")
    core = F.trim(F.lower(F.regexp_replace(core, _SNAKE, "")))
    # one chain of replacements, each used once, so that no expression is copied; "|" keeps the s of "ses" from the last one
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, "ies$", "y"), "ses$", "s|"), r"(?<!s)s$|\|$", "")
    stop = sorted(_STOP_CHAINS if chains else _STOP)
    return F.when(~F.lower(name).isin(*stop), F.get(F.filter(F.array(one), lambda x: F.length(x) >= 3), F.lit(0)))


def role(path: Column | str, chains: bool = True) -> Column:
    """Role of a file by the first fragment of its path that tells one, else ``other``."""
    low = F.lower(col(path))
    out = None
    for name, pattern in _FRAGMENTS:
        pattern = pattern or ("/(migrations|alembic/versions)/" if chains else "/(migrations|alembic)/")
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("other")


def role_order(r: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), col(r)).cast("int")


def suffix_of(path: Column | str) -> Column:
    """``kind`` of names like ``thing.kind.ext``, else empty."""
    return F.regexp_extract(basename(path), r"[.]([a-z]+)[.][a-z]+$", 1)


def test_stem(path: Column | str) -> Column:
    """Base name of a test file without what marks it as one."""
    b = F.regexp_replace(basename(path), r"\.(spec|test)\.[^.]+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"_test\.[^.]+$", ""), "^test_", ""), r"\.[^.]+$", "")
