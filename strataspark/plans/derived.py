"""Inputs of the reference queries, derived from whole driver tables, each as a DataFrame and as SQL.

The driver tables hold no source code and no history, so that other things stand in for them:

* ``edges``: parts rest on their suppliers, suppliers and customers on their nations, nations on their regions;
* ``trade``: a nation rests on another when it buys more from it than it sells to it;
* ``commit_files``: an order is a commit, the parts in it (brand and name) are its files;
* ``members``: customers are files, nations within regions are modules;
* ``module_deps``: pairs of nations of which the first buys more than an average amount from the second;
* snapshots: the first and the second half of the months of events and orders;
* ``signals``: orders are observations about the pair of market segment and nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspark.plans.tables import spread


class Tables:
    """The driver's tables below a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(t: Tables) -> DataFrame:
    """(src, dst, weight)."""
    # a part's edges are made in one place: what is counted by part later is reduced before it is shuffled
    lines = spread(t.lineitem.select("l_partkey", "l_suppkey"), t.lineitem.count(), "l_partkey")
    part = lines.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).select(_id("part/", "l_partkey").alias("src"), _id("supplier/", "l_suppkey").alias("dst"), F.col("n").cast("long").alias("weight"))
    one = F.lit(1).cast("long")
    sup = t.supplier.select(_id("supplier/", "s_suppkey"), _id("nation/", "s_nationkey"), one)
    cus = t.customer.select(_id("customer/", "c_custkey"), _id("nation/", "c_nationkey"), one)
    nat = t.nation.select(_id("nation/", "n_nationkey"), _id("region/", "n_regionkey"), one)
    return part.union(sup).union(cus).union(nat)


KINDS_OF_NODES = ("part/", "supplier/", "customer/", "nation/", "region/")


def links(t: Tables) -> DataFrame:
    """(src, dst) of ``edges``, each as often as lines tell of it: for what asks only whether there is one, without a shuffle. Nodes are kinds and keys, see ``node_name``."""
    node = lambda prefix, key: F.when(F.col(key).isNotNull(), F.struct(F.lit(KINDS_OF_NODES.index(prefix)).cast("byte").alias("kind"), F.col(key).cast("long").alias("key")))
    out = t.lineitem.select(node("part/", "l_partkey").alias("src"), node("supplier/", "l_suppkey").alias("dst"))
    out = out.union(t.supplier.select(node("supplier/", "s_suppkey"), node("nation/", "s_nationkey"))).union(t.customer.select(node("customer/", "c_custkey"), node("nation/", "c_nationkey")))
    return out.union(t.nation.select(node("nation/", "n_nationkey"), node("region/", "n_regionkey")))


def node_name(node: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, KINDS_OF_NODES)), node["kind"].cast("int")), node["key"].cast("string"))


def named_links(t: Tables) -> DataFrame:
    return links(t).select(*[node_name(F.col(c)).alias(c) for c in ("src", "dst")])


EDGES = """edges AS (
  SELECT 'part/' || l_partkey AS src, 'supplier/' || l_suppkey AS dst, count(*) AS weight FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 1 FROM supplier
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 1 FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 1 FROM nation)"""


def flows(t: Tables) -> DataFrame:
    """(buyer, seller, quantity) between nations, inside them too."""
    sold = t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("seller")), "l_suppkey")
    bought = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("buyer")), "o_custkey")
    return sold.join(bought, "l_orderkey").groupBy("buyer", "seller").agg(F.sum("l_quantity").cast("long").alias("quantity"))


FLOWS = """flows AS (
  SELECT c_nationkey AS buyer, s_nationkey AS seller, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


def trade(t: Tables) -> DataFrame:
    """(src, dst): the net buyer of each pair of nations, and the seller."""
    f = flows(t).where("buyer <> seller")
    r = f.select(F.col("buyer").alias("seller"), F.col("seller").alias("buyer"), F.col("quantity").alias("back"))
    net = f.join(r, ["buyer", "seller"], "left").where("quantity > coalesce(back, 0)")
    return net.select(_id("nation/", "buyer").alias("src"), _id("nation/", "seller").alias("dst"))


TRADE = FLOWS + """, trade AS (
  SELECT 'nation/' || a.buyer AS src, 'nation/' || a.seller AS dst FROM flows a LEFT JOIN flows b ON a.buyer = b.seller AND a.seller = b.buyer
  WHERE a.buyer <> a.seller AND a.quantity > coalesce(b.quantity, 0))"""

#: File names of parts: the brand is the directory, the first word of the name the base, the type the extension.


def _part_file():
    return F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("/"), F.substring_index("p_name", " ", -1), F.lit("."), F.lower(F.substring("p_type", 1, 2)))


def commit_files(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", _part_file().alias("path")), "p_partkey").select(F.col("l_orderkey").cast("string").alias("hash"), "path")
    return rows.repartition("hash").distinct()  # what is gathered by commit later lies together


COMMITS = """commit_files AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS hash, replace(p_brand, '#', '') || '/' || string_split(p_name, ' ')[-1] || '.' || lower(p_type[1:2]) AS path
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def members(t: Tables) -> DataFrame:
    """(module, path, language): customers as files of nations."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.concat_ws("/", "r_name", "n_name").alias("module"))
    return t.customer.join(F.broadcast(places), "c_nationkey").select("module", F.concat("module", F.lit("/"), "c_name", F.lit(".ts")).alias("path"), F.lower("c_mktsegment").alias("language"))


MEMBERS = """members AS (
  SELECT r_name || '/' || n_name AS module, r_name || '/' || n_name || '/' || c_name || '.ts' AS path, lower(c_mktsegment) AS language
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def module_names(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey"), F.concat_ws("/", "r_name", "n_name").alias("id"), F.col("n_name").alias("name"))


MODULES = """mods AS (SELECT n_nationkey, r_name || '/' || n_name AS id, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey)"""


def module_deps(t: Tables) -> DataFrame:
    """(module, dep): a nation uses another when it buys from it what a pair of nations trades on average or more."""
    f = flows(t).where("buyer <> seller")
    f = f.crossJoin(F.broadcast(f.agg(F.avg("quantity").alias("mean")))).where("quantity >= mean")
    m = F.broadcast(module_names(t))
    return f.join(m.select(F.col("n_nationkey").alias("buyer"), F.col("id").alias("module")), "buyer").join(m.select(F.col("n_nationkey").alias("seller"), F.col("id").alias("dep")), "seller").select("module", "dep")


DEPS = FLOWS + ", " + MODULES + """, deps AS (
  SELECT a.id AS module, b.id AS dep FROM flows JOIN mods a ON a.n_nationkey = buyer JOIN mods b ON b.n_nationkey = seller
  WHERE buyer <> seller AND quantity >= (SELECT avg(quantity) FROM flows WHERE buyer <> seller))"""


def module_table(t: Tables) -> DataFrame:
    """``modules`` as the operators take them; the supplier names of a nation are its exports."""
    files = members(t).groupBy(F.col("module").alias("id")).agg(F.array_sort(F.collect_list("path")).alias("files"))
    n = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).cast("int").alias("n_exports"))
    return module_names(t).join(n, "n_nationkey", "left").join(files, "id", "left").select("id", "name", F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.coalesce("n_exports", F.lit(0)).alias("n_exports"))


MODULE_TABLE = MODULES + ", " + MEMBERS + """, modtab AS (
  SELECT id, name, coalesce(f.n, 0) AS n_files, CAST(coalesce(x.n, 0) AS INTEGER) AS n_exports FROM mods
  LEFT JOIN (SELECT module, count(*) AS n FROM members GROUP BY module) f ON f.module = id
  LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) x ON x.s_nationkey = mods.n_nationkey)"""

SPLIT = "2024-01-16"


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(src, dst, n) of events before and from the middle of the month: users, and kinds of events by hour."""
    e = t.events.select(_id("user/", "user_id").alias("src"), F.concat(F.lit("event/"), "event_type", F.lit("/"), F.hour("ts").cast("string")).alias("dst"), "ts")
    out = [e.where(c).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")) for c in (F.col("ts") < F.lit(SPLIT).cast("timestamp"), F.col("ts") >= F.lit(SPLIT).cast("timestamp"))]
    return out[0], out[1]


HALVES = f"""h AS (SELECT 'user/' || user_id AS src, 'event/' || event_type || '/' || hour(ts) AS dst, ts < TIMESTAMP '{SPLIT}' AS early FROM events),
a AS (SELECT src, dst, count(*) AS n FROM h WHERE early GROUP BY 1, 2), b AS (SELECT src, dst, count(*) AS n FROM h WHERE NOT early GROUP BY 1, 2)"""

KINDS = {"1-URGENT": "arch-pattern-match", "2-HIGH": "negative-space", "3-MEDIUM": "high-fan-in", "4-NOT SPECIFIED": "naming-pattern", "5-LOW": "no-import"}


def signals(t: Tables) -> DataFrame:
    """``signals``: one for each customer and order priority, in the scope of the customer's order and status.

    Strength is the share of a thousand that the value of these orders leaves, a bounded rational.
    """
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[F.col("o_orderpriority")]
    g = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").groupBy("c_name", "o_orderstatus", "o_orderpriority").agg(F.sum(F.floor("o_totalprice").cast("long")).alias("v"))
    return g.select(
        F.struct(F.lit(1).alias("stage"), F.col("c_name").alias("a"), F.concat("o_orderstatus", "o_orderpriority").alias("b")).alias("seq"), kind.alias("kind"), F.array("o_orderstatus", "c_name").alias("scope"),
        ((F.col("v") % 1000) / 1000).alias("strength"), F.lit("").alias("description"), F.create_map().cast("map<string,string>").alias("ctx"),
    )


SIGNALS = """g AS (
  SELECT c_name, o_orderstatus, o_orderpriority, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
sig AS (
  SELECT c_name, o_orderstatus, o_orderpriority, c_name || '|' || o_orderstatus AS key, (v % 1000) / 1000.0::DOUBLE AS strength,
         CASE o_orderpriority """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + """ END AS kind FROM g)"""


def metrics(t: Tables) -> DataFrame:
    """Metrics of parts as files: dependents are orders, impact is suppliers, frequency the share of lines sent back, tests are even sizes."""
    # one shuffle of keys, to tasks of a given size; the distinct orders and suppliers of a part are then counted where it lies, as changes in their order
    rows = t.lineitem.select("l_partkey", "l_orderkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("back"))
    rows = spread(rows, t.lineitem.count(), "l_partkey")
    for c in ("l_orderkey", "l_suppkey"):
        before = F.lag(c).over(Window.partitionBy("l_partkey").orderBy(c))
        rows = rows.withColumn(f"{c}_new", F.col(c).isNotNull() & ~F.col(c).eqNullSafe(before)).drop(c)
    n = lambda c: F.count(F.when(F.col(c), 1))
    m = rows.groupBy("l_partkey").agg(n("l_orderkey_new").cast("int").alias("fan_in"), n("l_suppkey_new").cast("int").alias("transitive_impact"), (n("back") / F.count(F.lit(1))).alias("change_frequency"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_type", "p_name")
    return m.join(p, "l_partkey").select(F.concat(F.lower("p_type"), F.lit("/api/"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("file"), "fan_in", "transitive_impact", "change_frequency", (F.col("p_type") == "PROMO").alias("on_critical_path"), (F.col("p_size") % 2 == 0).alias("has_tests"))


METRICS = """m AS (
  SELECT l_partkey, CAST(count(DISTINCT l_orderkey) AS INTEGER) AS fan_in, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS transitive_impact,
         count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE AS change_frequency FROM lineitem GROUP BY 1),
metrics AS (
  SELECT lower(p_type) || '/api/' || replace(p_name, ' ', '_') || '_' || l_partkey || '.py' AS file, fan_in, transitive_impact, change_frequency,
         p_type = 'PROMO' AS on_critical_path, p_size % 2 = 0 AS has_tests FROM m JOIN part ON p_partkey = l_partkey),
r AS (SELECT *, transitive_impact * 3 + fan_in * 2 + change_frequency * 20 + CASE WHEN on_critical_path THEN 15 ELSE 0 END - CASE WHEN has_tests THEN 10 ELSE 0 END AS raw FROM metrics),
s AS (SELECT *, CAST(greatest(0, least(100, floor(raw / greatest((SELECT max(raw) FROM r), 1.0::DOUBLE) * 100 + 0.5))) AS INTEGER) AS score FROM r),
risks AS (SELECT *, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS risk FROM s)"""


def page_files(t: Tables) -> DataFrame:
    """``files`` of pages: the host and path are the path."""
    return t.pages.select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.col("html").alias("content"), F.lit("html").alias("language"))


PAGE_FILES = "files AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, html AS content FROM pages)"

ROLES = (("model", "models"), ("schema", "schemas"), ("service", "services"), ("api", "api"), ("page", "pages"))


def resource_files(t: Tables) -> DataFrame:
    """Files named after parts, in directories by their type: each part's first word and colour make a name."""
    role = F.when(F.col("p_type") == "ECONOMY", "models").when(F.col("p_type") == "LARGE", "schemas").when(F.col("p_type") == "MEDIUM", "services").when(F.col("p_type") == "PROMO", "api").when(F.col("p_type") == "SMALL", "pages").otherwise("misc")
    ext = F.when(F.col("p_size") % 2 == 0, "py").otherwise("ts")
    name = F.concat(F.lit("get"), F.regexp_replace("p_name", " ", ""), F.regexp_replace("p_brand", "#", ""), F.lit("sService"))
    return t.part.select(F.concat(F.lit("src/"), role, F.lit("/"), name, F.lit("."), ext).alias("path"), F.when(ext == "py", "python").otherwise("typescript").alias("language")).distinct()


RESOURCE_FILES = r"""res AS (
  SELECT DISTINCT 'src/' || CASE p_type WHEN 'ECONOMY' THEN 'models' WHEN 'LARGE' THEN 'schemas' WHEN 'MEDIUM' THEN 'services' WHEN 'PROMO' THEN 'api' WHEN 'SMALL' THEN 'pages' ELSE 'misc' END
         || '/get' || replace(p_name, ' ', '') || replace(p_brand, '#', '') || 'sService.' || CASE WHEN p_size % 2 = 0 THEN 'py' ELSE 'ts' END AS path FROM part),
named AS (
  SELECT path AS file, CASE WHEN ends_with(path, 'py') THEN 'python' ELSE 'typescript' END AS language, lower(regexp_extract(path, '/get(.*)sService', 1)) AS resource,
         CASE string_split(path, '/')[2] WHEN 'models' THEN 'model' WHEN 'schemas' THEN 'schema' WHEN 'services' THEN 'service' WHEN 'api' THEN 'api' WHEN 'pages' THEN 'page' END AS role FROM res),
firsts AS (
  SELECT resource, role, min(file) AS file, CAST(CASE role WHEN 'model' THEN 1 WHEN 'schema' THEN 2 WHEN 'service' THEN 4 WHEN 'api' THEN 5 ELSE 8 END AS INTEGER) AS role_ord FROM named WHERE role IS NOT NULL GROUP BY 1, 2),
links AS (
  SELECT resource, role, role_ord, file, CASE WHEN ends_with(file, 'py') THEN 'python' ELSE 'typescript' END AS language
  FROM firsts WHERE resource IN (SELECT resource FROM firsts GROUP BY resource HAVING count(*) >= 2))"""
