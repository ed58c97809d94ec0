"""A code graph projected from relational tables, for queries at scale.

Regions, nations, customers and orders stand for crates, modules, files and functions;
parts are functions that orders call through line items; suppliers are structs that parts
refer to; brands are traits that parts implement. Conversations give long call chains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _key(table: str, column: str) -> Column:
    return F.concat(F.lit(f"{table}:"), F.col(column).cast("string"))


class Tables:
    """The tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def nodes(t: Tables) -> DataFrame:
    mark = F.create_map(*[F.lit(x) for pair in (("1-URGENT", "pub::"), ("2-HIGH", "test::"), ("3-MEDIUM", "bench::")) for x in pair])
    null = F.lit(None).cast("string")
    node = lambda df, name, key, kind, payload: df.select(_key(name, key).alias("id"), F.lit(kind).alias("type"), payload.alias("payload"))
    parts = [
        node(t.region, "region", "r_regionkey", "crate_root", F.col("r_name")),
        node(t.nation, "nation", "n_nationkey", "module", F.col("n_name")),
        node(t.customer, "customer", "c_custkey", "file", null),
        node(t.orders, "orders", "o_orderkey", "function", F.concat(F.coalesce(mark[F.col("o_orderpriority")], F.lit("")), F.lit("order"), F.col("o_orderkey").cast("string"))),
        node(t.part, "part", "p_partkey", "function", F.col("p_name")),
        node(t.supplier, "supplier", "s_suppkey", "struct", F.col("s_name")),
        node(t.part.select("p_brand").distinct(), "trait", "p_brand", "trait", F.col("p_brand")),
        node(t.part, "impl", "p_partkey", "impl", F.col("p_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(t: Tables) -> DataFrame:
    edge = lambda df, a, b, kind: df.select(_key(*a).alias("from_id"), _key(*b).alias("to_id"), F.lit(kind).alias("edge_type"))
    # Duplicates go while the keys are numbers: less to shuffle than the ids made of them.
    parts = [
        edge(t.nation, ("region", "n_regionkey"), ("nation", "n_nationkey"), "contains"),
        edge(t.customer, ("nation", "c_nationkey"), ("customer", "c_custkey"), "contains"),
        edge(t.orders, ("customer", "o_custkey"), ("orders", "o_orderkey"), "contains"),
        edge(t.lineitem.select("l_orderkey", "l_partkey").distinct(), ("orders", "l_orderkey"), ("part", "l_partkey"), "calls"),
        edge(t.lineitem.select("l_partkey", "l_suppkey").distinct(), ("part", "l_partkey"), ("supplier", "l_suppkey"), "references"),
        edge(t.part, ("impl", "p_partkey"), ("trait", "p_brand"), "implements_trait"),
    ]
    return reduce(DataFrame.unionByName, parts)


NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'crate_root' AS type, r_name AS payload FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'module', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'file', NULL FROM customer
  UNION ALL SELECT 'orders:' || o_orderkey, 'function', CASE o_orderpriority WHEN '1-URGENT' THEN 'pub::' WHEN '2-HIGH' THEN 'test::' WHEN '3-MEDIUM' THEN 'bench::' ELSE '' END || 'order' || o_orderkey FROM orders
  UNION ALL SELECT 'part:' || p_partkey, 'function', p_name FROM part
  UNION ALL SELECT 'supplier:' || s_suppkey, 'struct', s_name FROM supplier
  UNION ALL SELECT DISTINCT 'trait:' || p_brand, 'trait', p_brand FROM part
  UNION ALL SELECT 'impl:' || p_partkey, 'impl', p_name FROM part)"""

EDGES_SQL = """edges AS (
  SELECT 'region:' || n_regionkey AS from_id, 'nation:' || n_nationkey AS to_id, 'contains' AS edge_type FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey, 'contains' FROM orders
  UNION ALL SELECT DISTINCT 'orders:' || l_orderkey, 'part:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'references' FROM lineitem
  UNION ALL SELECT 'impl:' || p_partkey, 'trait:' || p_brand, 'implements_trait' FROM part)"""


def turn_nodes(t: Tables) -> DataFrame:
    """A function per turn; the first of every other conversation is an entry point."""
    name = F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), F.lit("main")).otherwise(F.concat(F.lit("turn"), F.col("turn").cast("string")))
    return t.conversations.select("conv_id", "turn").distinct().select(_turn("turn").alias("id"), F.lit("function").alias("type"), name.alias("payload"))


def _turn(column: str) -> Column:
    return F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col(column).cast("string"))


def turn_edges(t: Tables, cycle: bool = False) -> DataFrame:
    """Each turn calls the next one; with ``cycle`` the last one also calls the first."""
    turns = t.conversations.select("conv_id", "turn").distinct()
    steps = turns.join(turns.select("conv_id", F.col("turn").alias("next")), "conv_id").where("next = turn + 1").select("conv_id", "turn", "next")
    if cycle:
        ends = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.min("turn").alias("next")).where("turn > next")
        steps = steps.unionByName(ends)
    return steps.select(_turn("turn").alias("from_id"), _turn("next").alias("to_id"), F.lit("calls").alias("edge_type"))


_TURN = "'turn:' || conv_id || ':' || "
TURNS_SQL = f"""turns AS (SELECT DISTINCT conv_id, turn FROM conversations),
nodes AS (SELECT {_TURN} turn AS id, 'function' AS type, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'main' ELSE 'turn' || turn END AS payload FROM turns),
edges AS (SELECT {_TURN} turn AS from_id, {_TURN} (turn + 1) AS to_id, 'calls' AS edge_type FROM turns
  WHERE (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM turns))"""
CYCLE_SQL = TURNS_SQL[:-1] + f"""
  UNION ALL SELECT {_TURN} max(turn), {_TURN} min(turn), 'calls' FROM turns GROUP BY conv_id HAVING max(turn) > min(turn))"""


def order_commits(t: Tables) -> DataFrame:
    """An order is a commit, its parts are the files that it changes."""
    path = F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit(".rs"))
    return t.lineitem.select(F.col("l_orderkey").alias("commit_id"), path.alias("path"))


def _file(brand: Column) -> Column:
    """A brand's file; a file id has no ``#``, which begins the place in it."""
    return F.concat(F.lit("./"), F.replace(brand, F.lit("#"), F.lit("")), F.lit(".rs"))


def raw_functions(t: Tables) -> DataFrame:
    """A function per part in the file of its brand; names repeat, some are public or tests."""
    mark = F.when(F.col("p_size") % 4 == 0, "pub::").when(F.col("p_size") % 4 == 1, "pub::test::").otherwise("")
    return t.part.select(F.concat(_file(F.col("p_brand")), F.lit("#"), F.col("p_partkey").cast("string"), F.lit(":1")).alias("id"), F.lit("function").alias("type"), F.concat(mark, F.col("p_name")).alias("payload"))


def raw_placeholders(t: Tables, edge_type: str, qualified: bool = True) -> DataFrame:
    """Placeholder edges between parts through line items, and imports between brands' files: one for each supplier."""
    count = t.part.agg(F.count(F.lit(1)).alias("n"))
    caller = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("from_brand"))
    callee = t.part.select(F.col("p_partkey").alias("callee"), F.col("p_name").alias("name"), F.col("p_brand").alias("to_brand"))
    pairs = t.lineitem.crossJoin(F.broadcast(count)).select("l_partkey", "l_linenumber", (F.col("l_orderkey") % F.col("n")).alias("callee"))
    pairs = pairs.join(caller, "l_partkey").join(callee, "callee")
    source = F.concat(_file(F.col("from_brand")), F.lit("#"), F.col("l_partkey").cast("string"), F.lit(":1"))
    target = F.concat(_file(F.col("from_brand")), F.lit("::"), F.col("name"))
    if qualified:
        target = F.when(F.col("l_linenumber") == 3, F.concat(_file(F.col("from_brand")), F.lit("::m::"), F.col("name"))).when(F.col("l_linenumber") == 4, F.col("name")).otherwise(target)
    item = F.concat(_file(F.col("to_brand")), F.lit("#"), F.col("callee").cast("string"), F.lit(":1"))
    users = t.supplier.select(F.col("s_suppkey").alias("l_partkey"), F.col("s_nationkey").cast("long").alias("callee"), "s_acctbal").join(caller, "l_partkey").join(callee, "callee")
    imports = users.select(_file(F.col("from_brand")).alias("from_id"), F.when(F.col("s_acctbal") < 2000, _file(F.col("to_brand"))).otherwise(item).alias("to_id"), F.lit("imports").alias("edge_type"))
    return pairs.select(source.alias("from_id"), target.alias("to_id"), F.lit(edge_type).alias("edge_type")).unionByName(imports).distinct()


def _raw_sql(qualified: bool) -> str:
    target = "file || '::' || name"
    if qualified:
        target = f"CASE l_linenumber WHEN 3 THEN file || '::m::' || name WHEN 4 THEN name ELSE {target} END"
    return f"""fns AS (SELECT './' || replace(p_brand, '#', '') || '.rs' AS file, './' || replace(p_brand, '#', '') || '.rs#' || p_partkey || ':1' AS id, p_name AS name,
  CASE p_size % 4 WHEN 0 THEN 'pub::' WHEN 1 THEN 'pub::test::' ELSE '' END || p_name AS payload FROM part),
pairs AS NOT MATERIALIZED (SELECT './' || replace(a.p_brand, '#', '') || '.rs' AS file, l_partkey, l_linenumber, b.p_name AS name
  FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_orderkey % (SELECT count(*) FROM part)),
raw AS (SELECT DISTINCT file, file || '#' || l_partkey || ':1' AS from_id, {target} AS to_id FROM pairs),
imports AS (SELECT DISTINCT './' || replace(a.p_brand, '#', '') || '.rs' AS from_file, './' || replace(b.p_brand, '#', '') || '.rs' || CASE WHEN s_acctbal < 2000 THEN '' ELSE '#' || b.p_partkey || ':1' END AS imp
  FROM supplier JOIN part a ON a.p_partkey = s_suppkey JOIN part b ON b.p_partkey = s_nationkey)"""


def resolve_sql(calls: bool) -> str:
    """What the resolvers must give, as SQL."""
    key = "name" if calls else "payload"
    named = f"""WITH {_raw_sql(calls)},
ix AS (SELECT file, id, {key} AS name FROM fns),
loc AS (SELECT file, name, count(*) AS n, min(id) AS id FROM ix GROUP BY ALL),
glo AS (SELECT name, count(*) AS n, min(id) AS id FROM ix GROUP BY ALL),
cand AS (SELECT from_file, name, imp, id FROM imports JOIN ix ON imp = id
  UNION ALL SELECT from_file, name, imp, id FROM imports JOIN loc ON imp = file WHERE n = 1),
im AS (SELECT from_file, name, count(*) AS n, min_by(id, imp) AS id FROM cand GROUP BY ALL),
ph AS (SELECT from_id, file, CASE WHEN contains(to_id, '::') THEN split_part(to_id, '::', -1) ELSE to_id END AS name, len(string_split(to_id, '::')) > 2 AS qualified FROM raw)
"""
    own = "CASE WHEN loc.n = 1 THEN loc.id END"
    glob = "CASE WHEN glo.n = 1 THEN glo.id END"
    if calls:
        pick = f"CASE WHEN qualified OR loc.n IS NOT NULL THEN {own} WHEN ph.file IN (SELECT from_file FROM imports) THEN CASE WHEN im.n = 1 THEN im.id END ELSE {glob} END"
    else:
        pick = f"CASE WHEN loc.n IS NOT NULL THEN {own} ELSE coalesce(im.id, {glob}) END"
    return f"""{named} SELECT DISTINCT * FROM (SELECT from_id, {pick} AS to_id, '{"calls" if calls else "references"}' AS edge_type
FROM ph LEFT JOIN loc ON loc.file = ph.file AND loc.name = ph.name LEFT JOIN glo ON glo.name = ph.name
LEFT JOIN im ON im.from_file = ph.file AND im.name = ph.name) WHERE to_id IS NOT NULL"""
