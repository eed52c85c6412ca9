"""Path functions and predicates as column expressions; paths use ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(p: Column | str) -> Column:
    return F.substring_index(col(p), "/", -1)


def dirname(p: Column | str) -> Column:
    """All before the last slash, ``.`` where there is none."""
    p = col(p)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(p: Column | str) -> Column:
    return F.regexp_extract(col(p), r"(\.[^./]+)$", 1)


def stem(p: Column | str) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(basename(p), r"\.[^.]+$", "")


def normalise(p: Column | str) -> Column:
    """Resolve ``.`` and ``..`` segments; steps above the root stay as ``..``."""
    # element_at fails on an empty array under ANSI mode, so a sentinel stands below the stack
    guarded = lambda acc, s: (
        F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.element_at(acc, -1) != "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(s)))
    )
    walked = F.aggregate(F.split(col(p), "/"), F.array(F.lit("^")), guarded)
    return F.array_join(F.slice(walked, F.lit(2), F.size(walked)), "/")


def join(directory: Column | str, rest: Column | str) -> Column:
    return normalise(F.concat(col(directory), F.lit("/"), col(rest)))


def is_test(p: Column | str) -> Column:
    p = col(p)
    return basename(p).rlike(r"^test_|_test\.[^.]+$|\.(spec|test)\.[^.]+$") | p.contains("__tests__/") | p.contains("/test/") | p.contains("/tests/")


def is_entry_point(p: Column | str) -> Column:
    return F.lower(stem(p)).isin("__init__", "__main__", "app", "conftest", "index", "main", "mod", "setup")


def is_script(p: Column | str) -> Column:
    return col(p).rlike("/(bin|cmd|scripts)/")


def is_api(p: Column | str) -> Column:
    return col(p).rlike("/(handlers|controllers|routes|api)/")


def is_config(p: Column | str) -> Column:
    return F.lower(basename(p)).rlike("env|settings|config")


def is_migration(m: Column | str) -> Column:
    return col(m).rlike("versions|alembic|migration")


def is_library(m: Column | str) -> Column:
    return col(m).rlike("(packages|lib|sdk)/")


#: Directories whose files support production code: tests, docs, examples, benchmarks, fixtures, stories, scripts.
SUPPORT = r"(?i)(^|/)(__(fixtures|stories|tests)__|bench(marks?)?|documentation|docs?(_src)?|e2e|examples?|fixtures?|samples?|scripts?|spec|stories|tests?)/"


def is_support(p: Column | str) -> Column:
    return col(p).rlike(SUPPORT)
