"""Resolution of imports to files: equi-joins of ordered candidates with the file set.

Files are keyed three ways (whole path, path without extension, directory of an index-like file), and an import asks
for a few keys, so that no list of extensions is multiplied out. Of several matches the one of least rank wins, then
the least path, which stands for the order of discovery. What an import leads to depends on its source and, where it is
relative, on the directory of its file, so that each such request is answered once, however many files make it.

Deviations, for determinism: "the first file" is the least path; of Python directories without ``__init__`` one
below another is left out where a whole path segment agrees.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions import paths

JS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs")
GROUP = {"typescript": "js", "javascript": "js", "python": "py", "rust": "rs", "java": "java", "go": "go"}


#: What an answer depends on; ``dir`` is empty where the directory doesn't matter.
REQUEST = ["dir", "language", "is_relative", "source"]
_FROM_DIRECTORY = ("typescript", "javascript", "python", "rust")


def package_name(source: Column | str) -> Column:
    """Package of an import: two segments for a scope, else one."""
    s = paths.col(source)
    return F.when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1))


def group_of(language: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for p in sorted(GROUP.items()) for x in p])[paths.col(language)]


def file_keys(files: DataFrame) -> DataFrame:
    """(grp, key, kind, ext_rank, target): kind 0 whole path, 1 without extension, 2 directory of an index file."""
    ext, stem = paths.extension("path"), paths.stem("path")
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    grp = F.when(ext.isin(*JS), "js").when(ext == ".py", "py").when(ext == ".rs", "rs")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, JS)), ext), F.lit(0)).cast("int")
    index = F.when(grp == "js", stem == "index").when(grp == "py", F.col("path").endswith("__init__.py")).when(grp == "rs", stem == "mod")
    one = lambda g, key, kind, r: F.struct(g.alias("grp"), key.alias("key"), F.lit(kind).alias("kind"), r.alias("ext_rank"))
    top = paths.dirname("path")
    keys = F.array(one(F.lit("js"), F.col("path"), 0, F.lit(0)), one(grp, bare, 1, rank), F.when(index, one(grp, F.when(top == ".", "").otherwise(top), 2, rank)))
    return files.select(F.col("path").alias("target"), F.explode(keys).alias("k")).where("k.grp is not null").select("k.*", "target")


def _segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "/")


def _relative_keys() -> Column:
    """Keys that a relative import asks for, in order."""
    directory, source = F.col("dir"), F.col("source")
    raw = paths.join(directory, source)
    js = F.array(raw, F.regexp_replace(raw, r"\.[mc]?js$", ""))
    dots = F.length(F.regexp_extract(source, r"^(\.+)", 1))
    up = _segments(directory)
    base = F.slice(up, F.lit(1), F.greatest(F.size(up) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace(source, r"^\.+", ""), r"\."), lambda s: s != "")
    py = F.array(_joined(base, rest))
    plain = F.split(F.regexp_replace(source, "^(crate|self|super)::", ""), "::")
    above = F.slice(up, F.lit(1), F.greatest(F.size(up) - 1, F.lit(0)))
    parent = F.slice(plain, F.lit(1), F.size(plain) - 1)
    deep = F.size(plain) > 1
    src = F.array(F.lit("src"))
    rs = (
        F.when(~source.contains("::"), F.array(_joined(up, plain)))
        .when(source.startswith("super::"), F.array(_joined(above, plain), F.when(deep, _joined(above, parent))))
        .otherwise(F.array(_joined(src, plain), F.when(deep, _joined(src, parent)), _joined(plain), F.when(deep, _joined(parent))))
    )
    grp = group_of("language")
    return F.when(grp == "js", js).when(grp == "py", py).when(grp == "rs", rs)


def _match(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(*REQUEST, rank, target): the matches of asked keys (*REQUEST, grp, base, key)."""
    js = F.col("grp") == "js"
    # JavaScript tries all extensions of all bases before index files; the others finish one base first.
    # Bare names of other languages need their extension, so only JavaScript may name a file whole.
    rank = F.when(js, F.col("kind") * 1000 + F.col("base") * 100 + F.col("ext_rank")).otherwise(F.col("base") * 1000 + F.col("kind") * 100)
    fits = ~(js & (F.col("kind") == 0) & (F.col("base") > 0))
    return asked.join(keys, ["grp", "key"]).where(fits).select(*REQUEST, rank.cast("int").alias("rank"), "target")


def _asked(requests: DataFrame, keys: Column, shift: int = 0) -> DataFrame:
    out = requests.select(*REQUEST, group_of("language").alias("grp"), F.posexplode(keys).alias("base", "key"))
    return out.where("key is not null").withColumn("base", F.col("base") + shift)


def python_roots(files: DataFrame) -> DataFrame:
    """(package, root): directories that absolute Python imports start from, one a name."""
    py = files.where(F.col("path").endswith(".py")).select("path", paths.dirname("path").alias("dir"))
    packages = py.where(F.col("path").endswith("__init__.py")).select("dir").where("dir <> '.'").distinct()
    tops = packages.withColumn("up", paths.dirname("dir")).join(packages.select(F.col("dir").alias("up")), "up", "left_anti").select("dir")
    plain = py.where(~F.col("path").endswith("__init__.py") & (F.col("dir") != ".")).select("dir").distinct().join(packages, "dir", "left_anti")
    parts = F.split("dir", "/")
    above = plain.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("top"))
    inside = above.join(tops.select(F.col("dir").alias("top")), "top", "left_semi").union(above.where("top <> dir").join(plain.select(F.col("dir").alias("top")), "top", "left_semi"))
    names = lambda df, order: df.select(paths.basename("dir").alias("package"), "dir", F.lit(order).alias("order"))
    both = names(tops, 0).union(names(plain.join(inside.select("dir"), "dir", "left_anti"), 1))
    return both.groupBy("package").agg(F.min_by("dir", F.struct("order", "dir")).alias("root"))


def java_roots(files: DataFrame) -> DataFrame:
    """(package, root): first two package levels below a directory named ``java``."""
    parts = F.split("path", "/")
    at = F.array_position(parts, "java").cast("int")
    rows = files.where(F.col("path").endswith(".java")).select("path", parts.alias("p"), at.alias("at")).where((F.col("at") > 0) & (F.size("p") > F.col("at") + 1))
    levels = F.least(F.lit(2), F.size("p") - F.col("at") - 1)
    rows = rows.select(F.array_join(F.slice("p", F.col("at") + 1, levels), ".").alias("package"), F.array_join(F.slice("p", F.lit(1), F.col("at") + 2), "/").alias("root"))
    return rows.groupBy("package").agg(F.min("root").alias("root"))


def _containing(wanted: DataFrame, files: DataFrame, java_only: bool) -> DataFrame:
    """``wanted`` with ``target`` in place of ``part``: the least file whose path contains ``part``; without those that no file contains.

    All joins are on equality. A path contains what one of its beginnings ends in. Of three segments or more the last but one is a whole segment,
    so that these join to beginnings on the last two segments, and of two segments on the last; beginnings that files share are looked at once. One
    segment lies within one of the file's: it joins on up to three characters, any run of a segment, and what meets is compared.
    """
    pool = files.where(F.col("path").endswith(".java")) if java_only else files
    pool = pool.select(F.col("path").alias("target"))
    parts = wanted.select("part").distinct().withColumn("n", F.size(F.split("part", "/")))
    heads = pool.where(F.length("target") > 0).select("target", F.explode(F.expr("transform(sequence(1, length(target)), i -> substring(target, 1, i))")).alias("head"))
    heads = heads.where(F.col("head").contains("/")).groupBy("head").agg(F.min("target").alias("target"))
    last = lambda c, n: F.substring_index(c, "/", -n).alias("key")
    ends = lambda asked, n: asked.select("part", last("part", n)).join(heads.select("head", "target", last("head", n)), "key").where(F.col("head").endswith(F.col("part"))).select("part", "target")
    hits = ends(parts.where("n >= 3"), 2).union(ends(parts.where("n = 2"), 1))
    runs = lambda begin: F.array(*[F.substring(F.col("seg"), begin, F.lit(n)) for n in range(4)])
    first = pool.select("target", F.explode(F.array_distinct(F.split("target", "/"))).alias("seg")).groupBy("seg").agg(F.min("target").alias("target"))
    anywhere = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("seg"), F.lit(1))), runs))
    within = first.select("seg", "target", F.explode(F.array_distinct(anywhere)).alias("key"))
    hits = hits.union(parts.where("n = 1").select("part", F.substring("part", 1, 3).alias("key")).join(within, "key").where(F.col("seg").contains(F.col("part"))).select("part", "target"))
    return wanted.join(hits.groupBy("part").agg(F.min("target").alias("target")), "part").drop("part")


def request(directory: Column, language: Column | str, is_relative: Column | str, source: Column | str) -> list[Column]:
    """The columns ``REQUEST`` of an import of a file in ``directory``."""
    language, is_relative = paths.col(language), paths.col(is_relative)
    near = is_relative & language.isin(*_FROM_DIRECTORY)
    return [F.when(near, directory).otherwise("").alias("dir"), language.alias("language"), is_relative.alias("is_relative"), paths.col(source).alias("source")]


def resolved(imports: DataFrame, files: DataFrame, go_module: str = "", aliases: tuple[tuple[str, str], ...] = (), resolve_absolute: bool = False, languages: Collection[str] = tuple(GROUP)) -> DataFrame:
    """``imports`` with ``target``, by :func:`answers`."""
    asked = request(paths.dirname("path"), "language", "is_relative", "source")
    found = answers(imports.select(*asked), files, go_module, aliases, resolve_absolute, languages)
    return imports.withColumn("dir", asked[0]).join(found, REQUEST, "left").select(*imports.columns, "target")


def answers(requests: DataFrame, files: DataFrame, go_module: str = "", aliases: tuple[tuple[str, str], ...] = (), resolve_absolute: bool = False, languages: Collection[str] = tuple(GROUP)) -> DataFrame:
    """(*REQUEST, target) of the requests that lead to a file, one row each: relative resolution first, then the project index for imports that
    aren't relative.

    ``languages``: the ones that occur, where it is known that others don't; their steps stay out of the plan.
    """
    imports = requests.select(*REQUEST).distinct()
    keys = file_keys(files)
    absolute = ~F.col("is_relative") | (F.lit(resolve_absolute) & (F.col("language") == "go"))
    relative = imports.where(F.col("is_relative") & F.col("language").isin(*_FROM_DIRECTORY))
    found = [_match(_asked(relative, _relative_keys()), keys)]

    if "python" in languages:
        py = imports.where(absolute & (F.col("language") == "python")).withColumn("s", F.split("source", r"\.")).withColumn("package", F.element_at("s", 1))
        tail = F.slice("s", F.lit(2), F.size("s"))
        under = py.join(python_roots(files), "package").withColumn("r", F.split("root", "/"))
        deeper = F.when(F.size("s") > 2, _joined(F.col("r"), F.slice("s", F.lit(2), F.greatest(F.size("s") - 2, F.lit(0)))))
        found.append(_match(_asked(under, F.array(_joined(F.col("r"), tail), deeper)), keys))

    if aliases and {"typescript", "javascript"} & {*languages}:
        ts = imports.where(absolute & F.col("language").isin("typescript", "javascript"))
        bases = []
        for prefix, target in aliases:
            path = F.concat(F.lit(target), F.expr(f"substring(source, {len(prefix) + 1})"))
            fits = F.col("source").startswith(prefix)
            bases += [F.when(fits, paths.normalise(path)), F.when(fits, F.regexp_replace(paths.normalise(path), r"\.js$", ""))]
        # an alias whose path exists only whole, with its extension, isn't a match
        found.append(_match(_asked(ts, F.array(*bases), 1), keys))

    if "java" in languages:
        java = imports.where(F.col("language") == "java").withColumn("part", F.regexp_replace("source", r"\.", "/"))
        near = _containing(java.where("is_relative"), files, False).select(*REQUEST, F.lit(0).alias("rank"), "target")
        far = java.where(~F.col("is_relative"))
        heads = far.select(*REQUEST, F.explode(F.array_distinct(F.array(F.substring_index("source", ".", 1), F.substring_index("source", ".", 2)))).alias("package"))
        exact = heads.join(java_roots(files), "package").select(*REQUEST, F.concat("root", F.lit("/"), F.regexp_replace(F.expr("substring(source, length(package) + 2)"), r"\.", "/"), F.lit(".java")).alias("target"))
        exact = exact.join(files.select(F.col("path").alias("target")), "target", "left_semi").select(*REQUEST, F.lit(0).alias("rank"), "target")
        found += [near, exact, _containing(far, files, True).select(*REQUEST, F.lit(1).alias("rank"), "target")]

    if go_module and "go" in languages:
        go = imports.where(absolute & (F.col("language") == "go") & F.col("source").startswith(go_module))
        go = go.select(*REQUEST, F.regexp_replace(F.regexp_replace("source", "^" + re.escape(go_module), ""), "^/", "").alias("below")).where("below <> ''")
        own = files.where(F.col("path").endswith(".go")).select(F.col("path").alias("target"), paths.dirname("path").alias("d"))
        parts = F.split("d", "/")
        tree = own.select("target", "d", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("below"))
        tree = tree.groupBy("below").agg(F.min(F.struct((F.col("d") != F.col("below")).cast("int").alias("rank"), "target")).alias("m"))
        found.append(go.join(tree, "below").select(*REQUEST, F.col("m.rank").alias("rank"), F.col("m.target").alias("target")))

    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    return hits.groupBy(*REQUEST).agg(F.min(F.struct("rank", "target")).alias("m")).select(*REQUEST, F.col("m.target").alias("target"))


def resolve_first(wanted: DataFrame, candidates: Column, keys: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``wanted`` rows with the first of their ``candidates`` (an array, in order) that ``keys`` has."""
    asked = wanted.select(*by, F.posexplode(candidates).alias("rank", key))
    return asked.join(keys.select(key).distinct(), key).groupBy(*by).agg(F.min_by(key, "rank").alias(key))
