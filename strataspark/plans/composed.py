"""Queries through whole operators, fed with inputs that whole driver tables give: graph, modules, signals, patterns, rules, health,
catalogue, incremental scans, snapshots and the query surface."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.config import Config, Thresholds
from strataspark.functions import paths
from strataspark.operators import api, cochange, graph, health, insights, modules, patterns, risk, rules, signals
from strataspark.plans import derived as d
from strataspark.plans.derived import Tables
from strataspark.plans.registry import query, rounded
from strataspark.plans.tables import shared_dir
from strataspark.sources import files, sinks
from strataspark.streaming import incremental


def _text(c: str):
    return F.col(c).cast("string")


# -- graph


def _line_imports(t: Tables) -> DataFrame:
    """Order lines as imports: a part imports its supplier; what is sent back does so dynamically, whole months from outside."""
    return t.lineitem.select(
        F.concat(F.lit("src/part"), _text("l_partkey")).alias("path"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("src/supplier"), _text("l_suppkey"))).alias("target"), F.concat(F.lit("@org/s"), _text("l_suppkey"), F.lit("/lib")).alias("source"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"), (F.col("l_returnflag") == "R").alias("is_dynamic"), (F.col("l_linestatus") == "F").alias("is_relative"),
        F.when(F.col("l_quantity") >= 10, F.array(F.concat(F.lit("q"), F.floor("l_quantity").cast("string")))).otherwise(F.array().cast("array<string>")).alias("specifiers"), F.col("l_linenumber").cast("int").alias("line"),
    ).dropDuplicates(["path", "ord", "target"])


_LINE_IMPORTS = """imp AS (SELECT DISTINCT ON (path, ord, target) * FROM (SELECT 'src/part' || l_partkey AS path, CASE WHEN l_linestatus = 'F' THEN 'src/supplier' || l_suppkey END AS target, '@org/s' || l_suppkey AS package,
  l_orderkey * 100 + l_linenumber AS ord, l_returnflag = 'R' AS dyn, CASE WHEN l_quantity >= 10 THEN 'q' || CAST(floor(l_quantity) AS BIGINT) ELSE '*' END AS symbol FROM lineitem))"""


@query(f"WITH {_LINE_IMPORTS} SELECT path AS src, target AS dst, CAST(count(*) AS INTEGER) AS weight, CAST(min(ord) AS BIGINT) AS first_ord FROM imp WHERE target IS NOT NULL GROUP BY 1, 2")
def edge_weights(t: Tables) -> DataFrame:
    return graph.build_edges(_line_imports(t)).select("src", "dst", "weight", F.col("ord").cast("long").alias("first_ord"))


@query(f"WITH {_LINE_IMPORTS}, n AS (SELECT path AS id, 'module' AS type FROM imp UNION SELECT target, 'module' FROM imp WHERE target IS NOT NULL) SELECT id, regexp_replace(id, '^.*/', '') AS label, type FROM n UNION ALL SELECT DISTINCT 'ext:' || package, package, 'external' FROM imp WHERE target IS NULL")
def node_set(t: Tables) -> DataFrame:
    i = _line_imports(t)
    return graph.build_nodes(i.select("path"), graph.build_edges(i), graph.externals(i))


@query(f"WITH {_LINE_IMPORTS}, {d.MODULES} SELECT id, name AS label, 'module' AS type FROM mods UNION ALL SELECT DISTINCT 'ext:' || package, package, 'external' FROM imp WHERE target IS NULL")
def module_node_set(t: Tables) -> DataFrame:
    return graph.module_nodes(d.module_names(t), graph.externals(_line_imports(t)))


_REACH = """reach(src, dst) AS (SELECT src, dst FROM trade UNION SELECT reach.src, t.dst FROM reach JOIN trade t ON t.src = reach.dst),
m AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"""
_CYCLES = f"""WITH RECURSIVE {d.TRADE}, {_REACH}, inside AS (SELECT a.component, src, dst FROM trade JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.component = b.component),
walk(component, node, files, k) AS (SELECT component, node, [node], 0 FROM m WHERE node = component UNION ALL SELECT w.component, i.dst, list_append(files, i.dst), k + 1 FROM walk w JOIN inside i ON i.component = w.component AND i.src = w.node WHERE k < 4 AND (k = 0 OR w.node <> w.component)),
c AS (SELECT component, files, k FROM walk WHERE k > 0 AND node = component), s AS (SELECT component, min(k) AS k FROM c GROUP BY 1)
SELECT component, array_to_string(min(files), ' > ') AS files, CAST(k AS INTEGER) AS length FROM c JOIN s USING (component, k) GROUP BY component, k"""


@query(_CYCLES)
def cycles(t: Tables) -> DataFrame:
    """Every component of the trade between nations has a circle of four steps at most."""
    return graph.cycles(d.trade(t)).select("component", F.array_join("files", " > ").alias("files"), "length")


@query(_CYCLES)
def cycles_spread(t: Tables) -> DataFrame:
    """The same in loops over tables."""
    return graph.cycles(d.trade(t), local=0).select("component", F.array_join("files", " > ").alias("files"), "length")


@query(f"WITH RECURSIVE {d.TRADE}, {_REACH} SELECT node, component FROM m")
def cyclic_nodes_spread(t: Tables) -> DataFrame:
    return graph.components(d.trade(t), local=0)


@query(f"""WITH RECURSIVE {d.EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
down(node, k) AS (SELECT node, 1 FROM n UNION SELECT e.src, k + 1 FROM down JOIN e ON e.dst = down.node), l AS (SELECT node, max(k) AS k FROM down GROUP BY 1),
nxt AS (SELECT src, min(dst) AS dst FROM e JOIN l a ON a.node = src JOIN l b ON b.node = dst WHERE b.k = a.k - 1 GROUP BY 1),
top AS (SELECT node, k FROM l WHERE node NOT IN (SELECT dst FROM e) AND k >= 3 ORDER BY k DESC, node LIMIT 10),
walk(leaf, node, files, k) AS (SELECT node, node, node, k FROM top UNION ALL SELECT leaf, nxt.dst, files || ' > ' || nxt.dst, k FROM walk JOIN nxt ON src = node)
SELECT files, CAST(k AS INTEGER) AS length, node AS root_file, leaf AS leaf_file FROM walk WHERE node NOT IN (SELECT src FROM nxt)""")
def critical_paths(t: Tables) -> DataFrame:
    return graph.critical_paths(d.links(t), name=d.node_name).withColumn("files", F.array_join("files", " > "))


# -- modules


def _barrels(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, with an index file for nations of two regions; exports; imports: customers' files export what they order, index files one name, and
    each order is an import, urgent ones relative."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name").isin("ASIA", "EUROPE")).select(F.concat_ws("/", "r_name", "n_name").alias("module"))
    members = d.members(t).union(places.select("module", F.concat("module", F.lit("/index.ts")), F.lit("typescript")))
    own = d.members(t).select("path", F.substring_index(F.substring_index("path", "/", -1), ".", 1).alias("c_name"))
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").join(own, "c_name")
    ex = o.select("path", F.lit(0).alias("ord"), F.col("o_orderpriority").alias("name"), F.lit("constant").alias("kind"), F.lit(1).alias("line")).distinct()
    ex = ex.union(places.select(F.concat("module", F.lit("/index.ts")), F.lit(0), F.lit("all"), F.lit("unknown"), F.lit(1)))
    imports = o.select("path", F.concat(F.lit("pkg-"), F.lower("o_orderstatus"), F.lit("/x")).alias("source"), (F.col("o_orderpriority") == "1-URGENT").alias("is_relative"))
    return members, ex, imports


_BARRELS = d.DEPS + ", " + d.MEMBERS + """, b AS (SELECT r_name || '/' || n_name AS module FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')),
mem AS (SELECT module, path, language FROM members UNION ALL SELECT module, module || '/index.ts', 'typescript' FROM b),
o AS (SELECT path, module, o_orderpriority AS p, o_orderstatus AS st FROM orders JOIN customer ON c_custkey = o_custkey JOIN members ON ends_with(path, '/' || c_name || '.ts')),
ex AS (SELECT DISTINCT module, path, p AS name FROM o WHERE module NOT IN (SELECT module FROM b) UNION ALL SELECT module, module || '/index.ts', 'all' FROM b),
ext AS (SELECT module, 'pkg-' || lower(chr(k)) AS package FROM (SELECT module, ascii(st) AS k, count(*) AS n FROM o WHERE p <> '1-URGENT' GROUP BY 1, 2)),
lang AS (SELECT module, arg_min(language, struct_pack(a := -n, b := p)) AS language FROM (SELECT module, language, count(*) AS n, min(path) AS p FROM mem GROUP BY 1, 2) GROUP BY 1)"""


def _modules(t: Tables) -> DataFrame:
    members, ex, imports = _barrels(t)
    return modules.modules(members, modules.public_api(members, ex), d.module_deps(t), modules.external_deps(members, imports))


@query(f"""WITH {_BARRELS} SELECT m.module AS id, string_split(m.module, '/')[2] AS name, lang.language, CAST(count(*) AS INTEGER) AS n_files, min(m.path) AS first_file,
  CAST((SELECT count(*) FROM ex WHERE ex.module = m.module) AS INTEGER) AS n_exports, coalesce((SELECT string_agg(dep, '|' ORDER BY dep) FROM deps WHERE deps.module = m.module), '') AS internal_deps,
  coalesce((SELECT string_agg(package, '|' ORDER BY package) FROM ext WHERE ext.module = m.module), '') AS external_deps FROM mem m JOIN lang ON lang.module = m.module GROUP BY m.module, lang.language""")
def module_rows(t: Tables) -> DataFrame:
    m = _modules(t)
    return m.select("id", "name", "language", F.size("files").alias("n_files"), F.element_at("files", 1).alias("first_file"), "n_exports", F.array_join("internal_deps", "|").alias("internal_deps"), F.array_join("external_deps", "|").alias("external_deps"))


@query(f"WITH {d.MODULES}, k AS (SELECT c_nationkey AS n, ascii(o_orderstatus) AS s, count(*) AS c FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2) SELECT id AS module, 'pkg-' || lower(chr(s)) AS package FROM k JOIN mods ON n_nationkey = n")
def external_deps(t: Tables) -> DataFrame:
    members, _, imports = _barrels(t)
    return modules.external_deps(members, imports)


@query(f"WITH {_BARRELS} SELECT m.module AS id, CAST(count(DISTINCT m.path) AS INTEGER) AS file_count, coalesce((SELECT string_agg(name || ' (' || CASE name WHEN 'all' THEN 'unknown' ELSE 'constant' END || ')', '|' ORDER BY path, name) FROM ex WHERE ex.module = m.module), '') AS public_api FROM mem m GROUP BY 1")
def get_modules(t: Tables) -> DataFrame:
    members, ex, _ = _barrels(t)
    api_rows = modules.public_api(members, ex)
    return api.get_modules(_modules(t), api_rows).select("id", "file_count", F.array_join("public_api", "|").alias("public_api"))


@query(f"WITH {_BARRELS} SELECT module AS id, CAST(count(*) AS INTEGER) AS n_files FROM mem WHERE module LIKE '%/NATION_1' GROUP BY 1")
def get_module(t: Tables) -> DataFrame:
    return api.get_module(_modules(t), "NATION_1").select("id", F.size("files").alias("n_files"))


# -- signals


def _uses(t: Tables) -> DataFrame:
    """Edges into members: a clerk's order uses a customer's file, and its priority and status are the symbol."""
    own = d.members(t).select("path", F.substring_index(F.substring_index("path", "/", -1), ".", 1).alias("c_name"))
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").join(own, "c_name")
    rows = o.select(F.concat(F.lit("order/"), _text("o_orderkey")).alias("path"), F.col("path").alias("target"), F.col("o_orderkey").alias("ord"), F.lit(False).alias("is_dynamic"), F.array(F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1))).alias("specifiers"), F.lit(1).alias("line"))
    return graph.build_edges(rows)


_USED = d.MODULE_TABLE + """, used AS (SELECT mods.id, count(DISTINCT o_orderstatus || o_orderpriority[1]) AS used FROM orders JOIN customer ON c_custkey = o_custkey JOIN mods ON n_nationkey = c_nationkey GROUP BY 1),
x AS (SELECT id, n_exports * 5 AS n_exports, coalesce(used, 0) AS used FROM modtab LEFT JOIN used USING (id))"""


@query(f"WITH {_USED} SELECT id, used FROM used")
def used_symbols(t: Tables) -> DataFrame:
    return signals.used_symbols(d.members(t), _uses(t))


def _wide(t: Tables) -> DataFrame:
    """Modules with five names for each supplier, so that some are wider than their use."""
    return d.module_table(t).withColumn("n_exports", F.col("n_exports") * 5)


def _plain(df: DataFrame) -> DataFrame:
    return df.select("kind", F.array_join("scope", "|").alias("scope"), rounded("strength"))


@query(f"""WITH {_USED}, y AS (SELECT *, greatest(0, n_exports - used) AS unused FROM x WHERE n_exports > 0)
SELECT 'narrow-api' AS kind, id AS scope, 0.5::DOUBLE AS strength FROM y WHERE n_exports <= 5 UNION ALL SELECT 'unused-exports', id, 0.4 FROM y WHERE unused > n_exports * 0.5 AND unused >= 3""")
def sig_exports(t: Tables) -> DataFrame:
    return _plain(signals.export_surface(_wide(t), signals.used_symbols(d.members(t), _uses(t))))


@query(f"WITH {_USED} SELECT CASE WHEN n_exports - used > n_exports * 0.7 AND n_exports - used >= 20 THEN 'warning' ELSE 'info' END AS severity, 'over-exposed-api' AS metric, 'over-exposed-api:' || id AS id FROM x WHERE n_exports >= 3 AND n_exports - used > n_exports * 0.5 AND n_exports - used >= 3")
def ins_over_exposed(t: Tables) -> DataFrame:
    return insights.over_exposed(_wide(t), signals.used_symbols(d.members(t), _uses(t)), Thresholds(exposed_least=3)).select("severity", "metric", "id")


@query("""WITH f AS (SELECT DISTINCT CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'tests/' ELSE CASE WHEN p_type = 'LARGE' THEN 'lib/' ELSE 'src/' END END || replace(p_brand, '#', '') AS dir FROM part)
SELECT 'test-alignment' AS kind, s.dir AS scope, 0.4::DOUBLE AS strength, t.dir AS tests FROM f t JOIN f s ON starts_with(t.dir, 'tests/') AND s.dir IN (replace(t.dir, 'tests/', 'src/'), replace(t.dir, 'tests/', 'lib/'))""")
def sig_test_alignment(t: Tables) -> DataFrame:
    root = F.when(F.col("p_type").isin("SMALL", "PROMO"), "tests/").when(F.col("p_type") == "LARGE", "lib/").otherwise("src/")
    f = t.part.select(F.concat(root, F.regexp_replace("p_brand", "#", ""), F.lit("/f"), _text("p_partkey"), F.lit(".py")).alias("path"))
    found = signals.test_alignment(f)
    return found.select("kind", F.array_join("scope", "|").alias("scope"), "strength", F.col("ctx")["testDir"].alias("tests"))


_CONTRACT_SQL = """sized AS (SELECT hash FROM commit_files GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20),
pairs AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS occurrences FROM commit_files a JOIN commit_files b ON a.hash = b.hash AND a.path < b.path JOIN sized ON sized.hash = a.hash
  WHERE string_split(a.path, '/')[1] <> string_split(b.path, '/')[1] OR string_split(a.path, '.')[2] <> string_split(b.path, '.')[2] GROUP BY 1, 2),
counts AS (SELECT path, count(*) AS n FROM commit_files GROUP BY 1),
jac AS (SELECT file_a, file_b, occurrences, occurrences / (x.n + y.n - occurrences)::DOUBLE AS confidence FROM pairs JOIN counts x ON x.path = file_a JOIN counts y ON y.path = file_b WHERE occurrences >= (SELECT CASE WHEN count(DISTINCT hash) < 50 THEN 2 WHEN count(DISTINCT hash) < 200 THEN 3 ELSE 5 END FROM commit_files))"""


@query(f"WITH {d.COMMITS}, {_CONTRACT_SQL} SELECT 'co-change' AS kind, file_a || '|' || file_b AS scope, round(least(0.85, confidence), 6) AS strength, CAST(occurrences AS VARCHAR) AS n FROM jac WHERE confidence >= 0.01")
def sig_contracts(t: Tables) -> DataFrame:
    found = signals.from_contracts(cochange.contracts(d.commit_files(t), 0.01, None, source=None))
    return _plain(found.withColumn("n", F.col("ctx")["coChangeCount"])).join(found.select(F.array_join("scope", "|").alias("scope"), F.col("ctx")["coChangeCount"].alias("n")), "scope").select("kind", "scope", "strength", "n")


_CODE_COMMITS = """code AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS hash, replace(p_brand, '#', '') || '/' || string_split(p_name, ' ')[-1] || CASE p_type WHEN 'ECONOMY' THEN '.py' WHEN 'LARGE' THEN '.ts' WHEN 'MEDIUM' THEN '.go' WHEN 'PROMO' THEN '.md' ELSE '.json' END AS path FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"""WITH {_CODE_COMMITS}, own AS (SELECT * FROM code WHERE regexp_matches(path, '\\.(py|ts|go)$')), sized AS (SELECT hash FROM own GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)
SELECT a.path AS file_a, b.path AS file_b, count(*) AS occurrences FROM own a JOIN own b ON a.hash = b.hash AND a.path < b.path JOIN sized ON sized.hash = a.hash
WHERE string_split(a.path, '/')[1] <> string_split(b.path, '/')[1] OR string_split(a.path, '.')[2] <> string_split(b.path, '.')[2] GROUP BY 1, 2""")
def co_change_sources(t: Tables) -> DataFrame:
    """Pairs of source files at the default limits; documents and settings don't count."""
    ext = F.when(F.col("p_type") == "ECONOMY", ".py").when(F.col("p_type") == "LARGE", ".ts").when(F.col("p_type") == "MEDIUM", ".go").when(F.col("p_type") == "PROMO", ".md").otherwise(".json")
    names = t.part.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.substring_index("p_name", " ", -1), ext).alias("path"))
    c = t.lineitem.join(names, "l_partkey").select(_text("l_orderkey").alias("hash"), "path").distinct()
    return cochange.pairs(c).groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("occurrences"))


_BRANDS = """bm AS (SELECT DISTINCT string_split(path, '/')[1] AS module, path FROM commit_files), bt AS (SELECT DISTINCT module AS id FROM bm),
bd AS (SELECT a.id AS module, b.id AS dep FROM bt a JOIN bt b ON a.id < b.id AND length(a.id) < length(b.id)),
fan AS (SELECT dep AS id, count(*) AS n FROM bd GROUP BY 1), fr AS (SELECT module AS id, count(*) / (SELECT count(DISTINCT hash) FROM commit_files)::DOUBLE AS f FROM bm JOIN commit_files USING (path) GROUP BY 1)"""


@query(f"""WITH {d.COMMITS}, {_BRANDS} SELECT 'change-frequency' AS kind, id AS scope, round(least(0.7, f), 6) AS strength FROM fr WHERE f > 0.15
UNION ALL SELECT 'unstable-hotspot', id, round(least(0.9, f * n / (SELECT count(*) FROM bt)), 6) FROM fr JOIN fan USING (id) WHERE f > 0.15 AND n >= 3""")
def sig_change_frequency(t: Tables) -> DataFrame:
    """Brands as modules; those of two digits use those of one."""
    c = d.commit_files(t)
    members = c.select(F.substring_index("path", "/", 1).alias("module"), "path").distinct()
    mods = members.select(F.col("module").alias("id"), F.col("module").alias("name")).distinct()
    deps = mods.select(F.col("id").alias("module")).join(mods.select(F.col("id").alias("dep")), F.expr("module < dep and length(module) < length(dep)"))
    return _plain(signals.change_frequency(c, members, mods, deps, 0.15))


def _diffs(t: Tables) -> DataFrame:
    """Orders as commits in the order of their keys; a line sent back is an import taken out."""
    word = F.when(F.col("o_orderpriority") == "1-URGENT", "Refactor ").when(F.col("o_orderpriority") == "2-HIGH", "remove ").otherwise("add ")
    head = t.orders.select(F.col("o_orderkey").alias("k"), F.concat(word, F.col("o_orderstatus")).alias("message"))
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("-import p"), _text("l_partkey"))).otherwise(F.concat(F.lit("+import p"), _text("l_partkey")))
    return t.lineitem.join(head, F.col("l_orderkey") == F.col("k")).select(F.col("k").cast("int").alias("ord"), _text("k").alias("hash"), "message", line.alias("line"))


_DIFFS = """dl AS (SELECT o_orderkey AS ord, CASE o_orderpriority WHEN '1-URGENT' THEN 'Refactor ' WHEN '2-HIGH' THEN 'remove ' ELSE 'add ' END || o_orderstatus AS message, l_returnflag = 'R' AS gone FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
firsts AS (SELECT ord, message, bool_or(gone) AS gone FROM dl GROUP BY 1, 2 ORDER BY ord LIMIT 100), rem AS (SELECT * FROM firsts WHERE gone AND NOT starts_with(message, 'add') ORDER BY ord LIMIT 20)"""


@query(f"WITH {_DIFFS} SELECT CAST(ord AS VARCHAR) AS hash, message, CAST(ord AS INTEGER) AS ord FROM rem")
def removed_imports(t: Tables) -> DataFrame:
    return cochange.removed_imports(_diffs(t))


@query(f"WITH {_DIFFS} SELECT 'removed-dependency' AS kind, '*' AS scope, 0.8::DOUBLE AS strength, CAST(ord AS VARCHAR) AS hash, message FROM rem")
def sig_removed(t: Tables) -> DataFrame:
    s = signals.from_removed(cochange.removed_imports(_diffs(t)))
    return s.select("kind", F.array_join("scope", "|").alias("scope"), "strength", F.col("ctx")["removedInCommit"].alias("hash"), F.col("ctx")["commitMessage"].alias("message"))


@query("""WITH n AS (SELECT list(n_name ORDER BY n_nationkey) AS l, list('../' || lower(n_name) ORDER BY n_nationkey) AS refs FROM nation)
SELECT 'import-restrictions' AS rule, '*' AS scope, 0.95::DOUBLE AS strength UNION ALL SELECT 'no-restricted-imports', '*', 0.95 UNION ALL SELECT 'paths', array_to_string(['@' || x for x in l], '|'), 0.7 FROM n
UNION ALL SELECT 'references', array_to_string(refs, '|'), 0.9 FROM n UNION ALL SELECT 'workspaces', (SELECT string_agg('packages/' || r_name, '|' ORDER BY r_regionkey) FROM region), 0.9""")
def sig_config(t: Tables) -> DataFrame:
    """Settings written from the names of nations and regions, which are few."""
    nations = [r.n_name for r in t.nation.select("n_name", "n_nationkey").orderBy("n_nationkey").collect()]
    regions = [r.r_name for r in t.region.select("r_name", "r_regionkey").orderBy("r_regionkey").collect()]
    texts = {
        "tsconfig.json": json.dumps({"compilerOptions": {"paths": {f"@{n}/*": [f"src/{n}/*"] for n in nations}}, "references": [{"path": f"../{n.lower()}"} for n in nations]}),
        "package.json": json.dumps({"workspaces": {"packages": [f"packages/{r}" for r in regions]}}), ".eslintrc.json": json.dumps({"rules": {"no-restricted-imports": "error"}}), "eslint.config.js": "broken {",
    }
    return signals.from_config(t.spark, texts).select(F.col("ctx")["configRule"].alias("rule"), F.array_join("scope", "|").alias("scope"), "strength")


# -- patterns

_WORDS = {"ECONOMY": "models", "LARGE": "controllers", "MEDIUM": "views", "PROMO": "ports", "SMALL": "adapters", "STANDARD": "core"}
_NAMED = "pm AS (SELECT DISTINCT p_brand || '/' || p_type AS id, CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORDS.items()) + " END || 'x' AS name FROM part)"
_KEYWORDS = "kw AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {i}, '{layer}', '{w}')" for i, (p, ls) in enumerate(patterns.LAYERS.items()) for layer, (_, ws) in ls.items() for w in ws.split()) + ") v(pattern, ord, layer, word))"
_SIZES = "CASE pattern " + " ".join(f"WHEN '{p}' THEN {len(ls)}" for p, ls in patterns.LAYERS.items() if ls) + " END"
_FITS = f"""{_NAMED}, {_KEYWORDS}, pd AS (SELECT DISTINCT a.id AS module, b.id AS dep FROM pm a JOIN pm b ON string_split(a.id, '/')[1] = string_split(b.id, '/')[1] AND a.id < b.id),
hit AS (SELECT pattern, ord, layer FROM pm JOIN kw ON contains(name, word)), n AS (SELECT pattern, ord, count(DISTINCT layer) AS k, max(CAST(layer = 'ports' AS INTEGER)) AS ports FROM hit GROUP BY 1, 2),
share AS (SELECT (SELECT count(*) FROM pd) / (SELECT count(*) FROM pm)::DOUBLE / ((SELECT count(*) FROM pm) - 1) AS s),
fits AS (SELECT pattern, ord, k / {_SIZES}::DOUBLE * CASE WHEN pattern = 'layered' THEN 0.8 ELSE 1 END AS confidence FROM n WHERE k >= 2 AND (pattern <> 'hexagonal' OR ports = 1)
  UNION ALL SELECT 'feature-based', 3, 1 - s FROM share WHERE s <= 0.3)"""


def _pattern_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Modules of brands and types, named after layers; of one brand, each uses those behind it."""
    word = F.create_map(*[F.lit(x) for p in _WORDS.items() for x in p])[F.col("p_type")]
    mods = t.part.select(F.concat_ws("/", "p_brand", "p_type").alias("id"), F.concat(word, F.lit("x")).alias("name")).distinct()
    brand = lambda c: mods.select(F.col("id").alias(c), F.substring_index("id", "/", 1).alias("brand"))
    return mods, brand("module").join(brand("dep"), "brand").where("module < dep").select("module", "dep")


@query(f"WITH {_FITS} SELECT pattern, round(confidence, 6) AS confidence FROM fits")
def pattern_confidence(t: Tables) -> DataFrame:
    return patterns.confidences(*_pattern_inputs(t)).select("pattern", rounded("confidence"))


@query(f"WITH {_FITS} SELECT pattern, round(confidence, 6) AS confidence FROM fits ORDER BY fits.confidence DESC, ord LIMIT 1")
def pattern_best(t: Tables) -> DataFrame:
    return patterns.best(patterns.confidences(*_pattern_inputs(t))).select("pattern", rounded("confidence"))


@query(f"""WITH {_FITS}, lay AS (SELECT DISTINCT pattern, layer, id FROM pm JOIN kw ON contains(name, word)) SELECT 'hexagonal' AS pattern, a.id || '|' || b.id AS scope, 0.85::DOUBLE AS strength FROM lay a JOIN lay b ON a.pattern = 'hexagonal' AND b.pattern = a.pattern AND a.layer = 'core' AND b.layer = 'adapters'
UNION ALL SELECT 'mvc', a.id || '|' || b.id, 0.7 FROM lay a JOIN lay b ON a.pattern = 'mvc' AND b.pattern = a.pattern AND a.layer = 'view' AND b.layer = 'model'
UNION ALL SELECT 'feature-based', (SELECT string_agg(id, '|' ORDER BY id) FROM pm), 0.5""")
def pattern_rules(t: Tables) -> DataFrame:
    mods, deps = _pattern_inputs(t)
    parts = [patterns.pattern_signals(mods, deps, (name, 1.0)).select(F.lit(name).alias("pattern"), F.array_join("scope", "|").alias("scope"), rounded("strength")) for name in ("hexagonal", "mvc", "feature-based")]
    return parts[0].union(parts[1]).union(parts[2])


# -- rules


@query("WITH " + d.SIGNALS + """, grp AS (SELECT key, c_name, min(o_orderstatus) AS st, count(*) AS n, count(DISTINCT kind) AS u, avg(strength) AS av, max(strength) AS top, max(CASE WHEN kind = 'negative-space' THEN strength END) AS sel,
  bool_or(kind = 'arch-pattern-match') AS pat, bool_or(kind = 'naming-pattern') AS nam, bool_or(kind = 'negative-space') AS neg, bool_or(kind = 'high-fan-in') AS fan, arg_max(kind, struct_pack(a := strength, b := -CAST(o_orderpriority[1] AS INTEGER))) AS main FROM sig GROUP BY 1, 2)
SELECT key, 'static-analysis' AS source, 'about ' || main || CASE WHEN neg AND main <> 'negative-space' THEN ' [left out on purpose: it uses 50% of the others]' ELSE '' END || CASE WHEN fan AND main <> 'high-fan-in' THEN ' [7 modules rest on it]' ELSE '' END || CASE WHEN pat AND main <> 'arch-pattern-match' THEN ' [fits layered]' ELSE '' END AS description,
  CASE WHEN pat THEN 'Keep to layered: respect its layers.' WHEN u >= 3 AND top >= 0.6 THEN 'Don''t break this; ' || n || ' signals agree.' WHEN u >= 2 OR (n = 1 AND top >= 0.8) THEN 'Keep to this without a reason not to; ' || n || ' signal(s).' ELSE 'For information.' END AS action,
  CAST(n AS INTEGER) AS instances, CAST(u AS INTEGER) AS kinds FROM grp""")
def rule_texts(t: Tables) -> DataFrame:
    """Texts, sources and evidence of rules; the context of each kind of signal is the same."""
    ctx = F.create_map(F.lit("selectivity"), F.lit("0.5"), F.lit("fanIn"), F.lit("7"), F.lit("detectedPattern"), F.lit("layered"))
    s = d.signals(t).withColumn("description", F.concat(F.lit("about "), "kind")).withColumn("ctx", ctx)
    r = rules.combine(s)
    return r.select(rules.scope_key().alias("key"), "source", "description", "action", F.col("evidence.total_instances").alias("instances"), F.get_json_object("evidence.details", "$.uniqueKinds").cast("int").alias("kinds"))


# -- risk


_PREDICATES = """p AS (SELECT DISTINCT CASE p_type WHEN 'SMALL' THEN 'pkg/tests/' WHEN 'PROMO' THEN 'pkg/api/' WHEN 'LARGE' THEN 'lib/docs/' WHEN 'MEDIUM' THEN 'x/scripts/' ELSE 'src/' END || CASE WHEN p_size % 5 = 0 THEN 'index' WHEN p_size % 5 = 1 THEN 'test_' || replace(p_name, ' ', '_') WHEN p_size % 5 = 2 THEN 'AppConfig' ELSE replace(p_name, ' ', '_') END || CASE WHEN p_size % 2 = 0 THEN '.py' ELSE '.TS' END AS path FROM part)"""


def _mixed_paths(t: Tables) -> DataFrame:
    folder = F.when(F.col("p_type") == "SMALL", "pkg/tests/").when(F.col("p_type") == "PROMO", "pkg/api/").when(F.col("p_type") == "LARGE", "lib/docs/").when(F.col("p_type") == "MEDIUM", "x/scripts/").otherwise("src/")
    own = F.regexp_replace("p_name", " ", "_")
    base = F.when(F.col("p_size") % 5 == 0, "index").when(F.col("p_size") % 5 == 1, F.concat(F.lit("test_"), own)).when(F.col("p_size") % 5 == 2, "AppConfig").otherwise(own)
    return t.part.select(F.concat(folder, base, F.when(F.col("p_size") % 2 == 0, ".py").otherwise(".TS")).alias("path")).distinct()


@query(f"""WITH {_PREDICATES} SELECT path, starts_with(path, 'pkg/tests/') OR contains(path, '/test_') AS is_test, contains(path, '/index.') AS is_entry_point, contains(path, '/scripts/') AS is_script, contains(path, '/api/') AS is_api, contains(path, 'AppConfig') AS is_config, starts_with(path, 'lib/') AS is_library,
  regexp_matches(path, '/(tests|docs|scripts)/') AS is_support, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '([^/.]*)\\.[^.]*$', 1) AS stem, regexp_extract(path, '(\\.[^.]*)$', 1) AS ext FROM p""")
def path_functions(t: Tables) -> DataFrame:
    p = _mixed_paths(t).withColumn("path", paths.normalise(F.concat(F.lit("./a/../"), "path")))
    return p.select("path", paths.is_test("path").alias("is_test"), paths.is_entry_point("path").alias("is_entry_point"), paths.is_script("path").alias("is_script"), paths.is_api("path").alias("is_api"), paths.is_config("path").alias("is_config"), paths.is_library("path").alias("is_library"), paths.is_support("path").alias("is_support"), paths.dirname("path").alias("dir"), paths.basename("path").alias("base"), paths.stem("path").alias("stem"), paths.extension("path").alias("ext"))


@query(f"""WITH {_PREDICATES} SELECT path, CASE WHEN ends_with(path, '.py') THEN 'python' ELSE 'typescript' END AS language, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext, regexp_matches(path, '/(tests|docs|scripts)/') AS is_support FROM p
WHERE NOT (starts_with(path, 'pkg/api/') AND NOT contains(path, '/index.')) AND NOT contains(path, 'small_')""")
def catalogue_files(t: Tables) -> DataFrame:
    """The catalogue with an ignore list: one directory but its index files, and names that hold a word."""
    raw = _mixed_paths(t).withColumn("content", F.lit("x")).union(t.region.select(F.concat(F.lit(".hidden/"), "r_name", F.lit(".py")), F.lit("x"))).union(t.region.select(F.concat("r_name", F.lit(".txt")), F.lit("x"))).union(t.region.select(F.concat(F.lit("node_modules/"), "r_name", F.lit(".ts")), F.lit("x")))
    return files.catalogue(raw, Config(), ("# comment", "pkg/api/*", "!index.*", "*small_*")).select("path", "language", "ext", "is_support")


_EDGE_RISKS = """lines AS (SELECT 'src/part' || l_partkey AS src, CASE WHEN l_suppkey % 3 = 0 THEN 'tests/' ELSE 'src/' END || 's' || l_suppkey || '.py' AS dst FROM lineitem),
fi AS (SELECT dst AS file, CAST(count(DISTINCT src) AS INTEGER) AS fan_in FROM lines GROUP BY 1),
f AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'tests/' ELSE 'src/' END || 's' || s_suppkey || '.py' AS file, s_suppkey % 3 = 0 AS is_support FROM supplier),
r AS (SELECT f.file, is_support, coalesce(fan_in, 0) AS fan_in, coalesce(fan_in, 0) * 5 AS raw FROM f LEFT JOIN fi USING (file)),
s AS (SELECT *, CAST(greatest(0, least(100, floor(raw / greatest((SELECT max(raw) FROM r), 1)::DOUBLE * 100 + 0.5))) AS INTEGER) AS sc FROM r)"""


@query(f"WITH {_EDGE_RISKS} SELECT file, fan_in, fan_in AS transitive_impact, CASE WHEN is_support THEN 0 ELSE sc END AS score, CASE WHEN is_support OR sc < 25 THEN 'low' WHEN sc >= 75 THEN 'critical' WHEN sc >= 50 THEN 'high' ELSE 'medium' END AS risk FROM s")
def file_risks_support(t: Tables) -> DataFrame:
    """Suppliers as files, a part of them support files, which are low whatever rests on them."""
    name = lambda c: F.concat(F.when(F.col(c) % 3 == 0, "tests/").otherwise("src/"), F.lit("s"), _text(c), F.lit(".py"))
    own = t.supplier.select(name("s_suppkey").alias("path"), (F.col("s_suppkey") % 3 == 0).alias("is_support"))
    e = t.lineitem.select(F.concat(F.lit("src/part"), _text("l_partkey")).alias("src"), name("l_suppkey").alias("dst"))
    fan = graph.fan_in(e)
    none = t.spark.createDataFrame([], "files array<string>")
    out = risk.file_risks(own, fan.select("node", F.col("fan_in").alias("impact")), fan, none)
    return out.select("file", "fan_in", "transitive_impact", "score", "risk")


# -- health

_NATION_RULES = d.MODULE_TABLE + """, hr AS (SELECT mods.id AS m, CASE n_regionkey WHEN 0 THEN 'boundary' WHEN 1 THEN 'layer' WHEN 2 THEN 'co-change' WHEN 3 THEN 'ownership' ELSE 'naming' END AS category,
  CASE n_nationkey % 3 WHEN 0 THEN 'rule' WHEN 1 THEN 'convention' ELSE 'observation' END AS tier, CASE WHEN n_nationkey < 3 THEN 'weakening' WHEN n_nationkey = 3 THEN 'broken' WHEN n_nationkey < 12 THEN 'strengthening' ELSE 'stable' END AS trend, n_nationkey % 7 = 6 AS bad FROM nation JOIN mods USING (n_nationkey)),
w AS (SELECT *, CASE tier WHEN 'rule' THEN 15 WHEN 'convention' THEN 5 ELSE 0 END * CASE category WHEN 'boundary' THEN 1.5 WHEN 'layer' THEN 1.3 WHEN 'co-change' THEN 1.0 WHEN 'ownership' THEN 0.8 ELSE 0.5 END::DOUBLE AS points FROM hr),
ins AS (SELECT r_name AS id, CASE r_regionkey WHEN 0 THEN 'bottleneck' WHEN 1 THEN 'circular-dependency' WHEN 2 THEN 'concentration-risk' WHEN 3 THEN 'untested-high-risk' ELSE 'god-module-size' END AS metric, CASE WHEN r_regionkey < 2 THEN 'critical' ELSE 'warning' END AS severity FROM region)"""


def _nation_rules(t: Tables) -> DataFrame:
    """A rule for each nation: category by region, tier, trend and violations by key."""
    k = F.col("n_nationkey")
    cat = F.array(*map(F.lit, ("boundary", "layer", "co-change", "ownership", "naming")))[F.col("n_regionkey")]
    tier = F.array(*map(F.lit, ("rule", "convention", "observation")))[(k % 3).cast("int")]
    trend = F.when(k < 3, "weakening").when(k == 3, "broken").when(k < 12, "strengthening").otherwise("stable")
    return t.nation.join(d.module_names(t).select("n_nationkey", "id"), "n_nationkey").select(F.col("id"), cat.alias("category"), tier.alias("tier"), trend.alias("trend"), F.array("id").alias("scope"), F.struct(F.when(k % 7 == 6, 1).otherwise(0).alias("recent_violations")).alias("evidence"))


def _region_insights(t: Tables) -> DataFrame:
    """An insight for each region, about the modules or the least file of one of its nations."""
    k = F.col("r_regionkey")
    metric = F.array(*map(F.lit, ("bottleneck", "circular-dependency", "concentration-risk", "untested-high-risk", "god-module-size")))[k]
    file = d.members(t).groupBy(F.substring_index("module", "/", 1).alias("r_name")).agg(F.min("path").alias("path"))
    r = t.region.join(file, "r_name", "left")
    return r.select(F.col("r_name").alias("id"), metric.alias("metric"), F.when(k < 2, "critical").otherwise("warning").alias("severity"), F.when(k < 3, F.col("path")).alias("file"), F.when(k >= 3, F.regexp_replace("path", "/[^/]*$", "")).alias("module"))


@query(f"""WITH {_NATION_RULES}, a AS (SELECT avg(n_files) AS av FROM modtab), l AS (SELECT sum(CASE WHEN bad THEN points * greatest(0.5, n_files / greatest(1, av)) ELSE 0 END) AS lost FROM w JOIN modtab ON modtab.id = m, a)
SELECT CAST(greatest(0, least(100, floor(100 - lost - (SELECT count(*) FROM w WHERE trend = 'weakening') * 3 - (SELECT count(*) FROM w WHERE trend = 'broken') * 8
  - (SELECT count(*) FILTER (metric = 'bottleneck') * 2 + count(*) FILTER (metric = 'circular-dependency') * 5 + CASE WHEN count(*) FILTER (metric = 'concentration-risk') > 0 THEN 10 ELSE 0 END + count(*) FILTER (metric = 'untested-high-risk') + count(*) FILTER (metric = 'god-module-size') FROM ins) + 0.5))) AS INTEGER) AS overall,
  CASE WHEN (SELECT count(*) FROM w WHERE trend = 'broken') > 0 THEN 'broken' ELSE 'other' END AS trend, (SELECT count(*) FROM w WHERE tier = 'observation') AS observations, (SELECT count(*) FROM w WHERE tier = 'convention') AS conventions,
  (SELECT count(*) FROM w WHERE tier = 'convention' AND bad) AS convention_violations, (SELECT count(*) FROM w WHERE tier = 'rule') AS rules, (SELECT count(*) FROM w WHERE tier = 'rule' AND bad) AS rule_violations FROM l""")
def health_overall(t: Tables) -> DataFrame:
    return health.health(_nation_rules(t), d.module_table(t), _region_insights(t))


@query(f"""WITH {_NATION_RULES}, t AS (SELECT 'all' AS part, trend FROM w WHERE trend <> 'broken' UNION ALL SELECT 'late', trend FROM w WHERE trend IN ('stable', 'weakening')),
n AS (SELECT part, count(*) AS n, count(*) FILTER (trend = 'weakening') AS weak, count(*) FILTER (trend = 'strengthening') AS strong FROM t GROUP BY 1)
SELECT part, CASE WHEN weak > n * 0.2 THEN 'weakening' WHEN strong > n * 0.2 THEN 'strengthening' ELSE 'stable' END AS trend FROM n""")
def health_trends(t: Tables) -> DataFrame:
    """The trend of all rules that aren't broken, and of those that don't get stronger either."""
    r, m, i = _nation_rules(t), d.module_table(t), _region_insights(t)
    one = lambda name, part: health.health(part, m, i).select(F.lit(name).alias("part"), "trend")
    return one("all", r.where("trend <> 'broken'")).union(one("late", r.where("trend in ('stable', 'weakening')")))


@query(f"""WITH {_NATION_RULES}, fm AS (SELECT string_split(module, '/')[1] AS r, min(path) AS path FROM members GROUP BY 1), im AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS module, id, metric, severity FROM ins JOIN fm ON r = id),
i AS (SELECT module, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS wn FROM im GROUP BY 1), v AS (SELECT m, sum(points) AS lost, count(*) AS n FROM w WHERE bad GROUP BY 1)
SELECT modtab.id AS module, CAST(greatest(0, least(100, floor(100 - coalesce(lost, 0) - coalesce(c, 0) * 3 - coalesce(wn, 0) + 0.5))) AS INTEGER) AS score, CAST(coalesce(v.n, 0) + coalesce(c, 0) AS INTEGER) AS violations FROM modtab LEFT JOIN v ON v.m = modtab.id LEFT JOIN i ON i.module = modtab.id""")
def module_scores(t: Tables) -> DataFrame:
    return health.module_scores(_nation_rules(t), d.module_table(t), _region_insights(t))


# -- incremental scans and snapshots


@query("SELECT 'docs/' || doc_id || '.py' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND text IS NOT NULL")
def changed_files(t: Tables) -> DataFrame:
    """Documents as files: those that have labels are as the cache knows them, the others were edited or are new."""
    now = t.documents.where("text is not null").select(F.concat(F.lit("docs/"), _text("doc_id"), F.lit(".py")).alias("path"), "doc_id", F.col("text").alias("content"))
    known = t.labels.select("doc_id").distinct()
    old = now.join(known, "doc_id", "left_semi").union(now.join(known, "doc_id", "left_anti").where("doc_id % 2 = 0").withColumn("content", F.concat("content", F.lit("#"))))
    return incremental.changed(now.drop("doc_id"), incremental.content_hash(old.drop("doc_id"))).select("path")


@query(f"WITH {d.EDGES} SELECT src, dst, CAST(weight AS BIGINT) AS weight FROM edges")
def snapshot_round_trip(t: Tables) -> DataFrame:
    """Written below the shared folder and read back."""
    base = f"{shared_dir(t.spark)}/strata/snapshot-{t.spark.sparkContext.applicationId}"
    return sinks.read_snapshot(t.spark, sinks.write_snapshot({"edges": d.edges(t)}, base, "run-1"))["edges"]


# -- query surface


def _impact(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    e = d.edges(t).withColumn("type", F.lit("import"))
    members = e.select(F.col("src").alias("path")).union(e.select("dst")).distinct().select(F.substring_index("path", "/", 1).alias("module"), "path")
    contracts = t.nation.select(F.concat(F.lit("nation/"), _text("n_nationkey")).alias("file_a"), F.concat(F.lit("region/"), _text("n_regionkey")).alias("file_b"))
    links = t.nation.select(F.concat(F.lit("res"), _text("n_regionkey")).alias("resource"), F.concat(F.lit("nation/"), _text("n_nationkey")).alias("file"))
    return members, e, contracts, links


@query(f"""WITH {d.EDGES}, c AS (SELECT 'nation/' || n_nationkey AS a, 'region/' || n_regionkey AS b FROM nation) SELECT 'module' AS part, 'nation' AS value UNION ALL SELECT 'dependent', src FROM edges WHERE dst = 'nation/1'
UNION ALL SELECT 'contract', a || ' ' || b FROM c WHERE contains(a, 'nation/1') OR contains('nation/1', a) OR contains(b, 'nation/1') OR contains('nation/1', b)
UNION ALL SELECT 'chain', 'nation/' || n_nationkey FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 1)""")
def check_impact(t: Tables) -> DataFrame:
    """All about one file; what is asked for by name also matches names that hold it."""
    r = api.check_impact("nation/1", *_impact(t))
    part = lambda name, df, c: df.select(F.lit(name).alias("part"), c.alias("value"))
    return part("module", r["module"], F.col("module")).union(part("dependent", r["dependents"], F.col("src"))).union(part("contract", r["contracts"], F.concat_ws(" ", "file_a", "file_b"))).union(part("chain", r["chain"], F.col("file")))


@query(f"WITH {d.EDGES}, m AS (SELECT src AS file FROM edges UNION SELECT dst FROM edges), n AS (SELECT dst AS file, count(DISTINCT src) AS k FROM edges GROUP BY 1) SELECT string_split(file, '/')[1] AS module, file, coalesce(k, 0) AS dependents FROM m LEFT JOIN n USING (file)")
def impact_of_all_files(t: Tables) -> DataFrame:
    members, e, _, _ = _impact(t)
    return api.impacted(e, members)


@query(f"WITH {_BARRELS} SELECT min(module) AS module FROM ex WHERE name = '5-LOW' AND module <> (SELECT min(module) FROM members)")
def defining_module(t: Tables) -> DataFrame:
    """Where a name that the least file of all uses is defined, its own module left aside."""
    members, ex, _ = _barrels(t)
    file = d.members(t).agg(F.min("path")).first()[0]
    return api.defining_module(members, modules.public_api(members, ex), file, "5-LOW")
