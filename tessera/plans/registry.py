"""Named queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import canonical_name, glob_regex, module_path
from ..operators import graph_queries as Q
from ..operators.extract import extract, raw_edges, raw_nodes, use_paths
from ..operators.modules import file_modules, resolve_imports, use_targets
from ..operators.reach import reach
from ..operators.resolve import resolve_calls, resolve_names
from ..sources.sinks import as_json, tsv
from . import relational_graph as G
from .datalog import run_script
from .indexing import build_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_N, _NE = f"WITH {G.NODES_SQL}", f"WITH RECURSIVE {G.NODES_SQL}, {G.EDGES_SQL}"
_T, _C = f"WITH RECURSIVE {G.TURNS_SQL}", f"WITH RECURSIVE {G.CYCLE_SQL}"
_ENTRY = "(payload = 'main' OR starts_with(payload, 'pub::') OR starts_with(payload, 'test::') OR starts_with(payload, 'bench::'))"


def _query(name: str, sql: str | None):
    def add(f: Callable[[G.Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(G.Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Storage and scans


@_query("graph_nodes", f"{_N} SELECT * FROM nodes")
def _(t):
    return G.nodes(t)


@_query("graph_edges", f"{_NE} SELECT * FROM edges")
def _(t):
    return G.edges(t)


@_query("node_count", f"{_N} SELECT count(*) AS n FROM nodes")
def _(t):
    return G.nodes(t).agg(F.count("id").alias("n"))


@_query("edge_count_by_type", f"{_NE} SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type")
def _(t):
    return G.edges(t).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@_query("upsert_nodes", f"{_N} SELECT id, type, CASE WHEN type = 'struct' THEN 'new' ELSE payload END AS payload FROM nodes")
def _(t):
    old = G.nodes(t)
    new = old.where("type = 'struct'").withColumn("payload", F.lit("new"))
    return old.join(new, "id", "left_anti").unionByName(new)


@_query("remove_edges", f"{_NE} SELECT * FROM edges WHERE NOT (edge_type = 'contains' AND starts_with(from_id, 'region:'))")
def _(t):
    all_ = G.edges(t)
    gone = all_.where("edge_type = 'contains'").where(F.col("from_id").startswith("region:"))
    return all_.join(gone, ["from_id", "to_id", "edge_type"], "left_anti")


@_query("tsv_sink", f"{_N} SELECT id || chr(9) || type || chr(9) || coalesce(payload, '—') AS value FROM nodes")
def _(t):
    return tsv(G.nodes(t), "—")


@_query("json_sink", "SELECT '{\"k\":' || s_suppkey || ',\"name\":\"' || s_name || '\",\"v\":null}' AS value FROM supplier")
def _(t):
    return as_json(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), (F.col("s_acctbal") * F.lit(float("nan"))).alias("v")))


# Search


@_query("search_ci", f"{_N} SELECT * FROM nodes WHERE contains(lower(payload), 'brand#1')")
def _(t):
    return Q.search_matches(G.nodes(t), "BRAND#1", True)


@_query("search_cs", f"{_N} SELECT * FROM nodes WHERE contains(payload, 'red')")
def _(t):
    return Q.search_matches(G.nodes(t), "red")


@_query("search_page", f"{_N} SELECT * FROM nodes WHERE contains(payload, 'ring') ORDER BY id LIMIT 20 OFFSET 10")
def _(t):
    return Q.text_search(G.nodes(t), "ring", limit=20, offset=10)[0]


@_query("search_total", f"{_N} SELECT count(*) AS n FROM nodes WHERE contains(lower(payload), 'pub::order1')")
def _(t):
    return Q.search_matches(G.nodes(t), "PUB::order1", True).agg(F.count("id").alias("n"))


@_query("search_documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'éa')")
def _(t):
    return Q.search_matches(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.col("text").alias("payload")), "ÉA", True).select(F.col("id").alias("doc_id"))


# Graph questions


@_query("node_info_out", f"{_NE} SELECT e.to_id AS id, edge_type, type AS node_type, payload FROM edges e JOIN nodes n ON n.id = e.to_id WHERE from_id = 'orders:7'")
def _(t):
    return Q.edges_out(G.nodes(t), G.edges(t), "orders:7")


@_query("node_info_in", f"{_NE} SELECT e.from_id AS id, edge_type, type AS node_type, payload FROM edges e JOIN nodes n ON n.id = e.from_id WHERE to_id = 'part:7'")
def _(t):
    return Q.edges_in(G.nodes(t), G.edges(t), "part:7")


@_query("node_info", f"{_NE} SELECT id, type AS node_type, payload, (SELECT count(*) FROM edges WHERE from_id = 'part:7') AS n_out, (SELECT count(*) FROM edges WHERE to_id = 'part:7') AS n_in FROM nodes WHERE id = 'part:7'")
def _(t):
    info = Q.node_info(G.nodes(t), G.edges(t), "part:7")
    return info.select("id", "node_type", "payload", F.size("outgoing_edges").cast("long").alias("n_out"), F.size("incoming_edges").cast("long").alias("n_in"))


def _callers_sql(prefix: str, target: str, depth: int) -> str:
    return f"""{prefix}, up(id, d) AS (SELECT from_id, 1 FROM edges WHERE to_id = '{target}' AND edge_type = 'calls'
UNION SELECT e.from_id, d + 1 FROM up JOIN edges e ON e.to_id = up.id AND e.edge_type = 'calls' WHERE d < {depth})
SELECT id, type, payload FROM nodes WHERE id IN (SELECT id FROM up) AND id != '{target}' ORDER BY id LIMIT 500"""


@_query("callers_d1", _callers_sql(_NE, "part:3", 1))
def _(t):
    return Q.callers(G.nodes(t), G.edges(t), "part:3", 1)


@_query("callers_d2", _callers_sql(_T, "turn:0:3", 2))
def _(t):
    return Q.callers(G.turn_nodes(t), G.turn_edges(t), "turn:0:3", 2)


@_query("callers_d3", _callers_sql(_T, "turn:1:3", 3))
def _(t):
    return Q.callers(G.turn_nodes(t), G.turn_edges(t), "turn:1:3", 3)


@_query("callers_cycle", _callers_sql(_C, "turn:0:2", 20))
def _(t):
    return Q.callers(G.turn_nodes(t), G.turn_edges(t, cycle=True), "turn:0:2", 20)


def _blast_sql(node: str) -> str:
    near = "edge_type IN ('calls', 'contains', 'references', 'changes_with')"
    return f"""{_NE}, hit(id) AS (SELECT to_id FROM edges WHERE from_id = '{node}' AND {near} UNION SELECT from_id FROM edges WHERE to_id = '{node}' AND {near}
UNION SELECT e.to_id FROM hit JOIN edges e ON e.from_id = hit.id AND e.edge_type IN ('calls', 'references', 'changes_with'))
SELECT id, type, payload FROM nodes WHERE id IN (SELECT id FROM hit) AND id != '{node}' ORDER BY id LIMIT 500"""


@_query("blast_radius_order", _blast_sql("orders:5"))
def _(t):
    return Q.blast_radius(G.nodes(t), G.edges(t), "orders:5")


@_query("blast_radius_part", _blast_sql("part:5"))
def _(t):
    return Q.blast_radius(G.nodes(t), G.edges(t), "part:5")


def _dead_sql(prefix: str, more: str = "") -> str:
    return f"""{prefix}, live(id) AS (SELECT id FROM nodes WHERE type = 'function' AND {_ENTRY}
UNION SELECT e.to_id FROM live JOIN edges e ON e.from_id = live.id AND e.edge_type IN ('calls', 'references'))
SELECT id FROM nodes WHERE type = 'function' AND id NOT IN (SELECT id FROM live){more}"""


@_query("dead_functions", _dead_sql(_NE))
def _(t):
    return Q.dead_functions(G.nodes(t), G.edges(t))


@_query("dead_functions_turns", _dead_sql(_C))
def _(t):
    return Q.dead_functions(G.turn_nodes(t), G.turn_edges(t, cycle=True))


@_query("dead_filtered_glob", _dead_sql(_NE, " AND regexp_full_match(id, 'orders:1[^23].*')"))
def _(t):
    return Q.dead_functions(G.nodes(t), G.edges(t)).where(F.col("id").rlike(glob_regex("orders:1[!23]*")))


@_query("reach_cycle", f"{_C}, hit(id) AS (SELECT 'turn:0:1' UNION SELECT e.to_id FROM hit JOIN edges e ON e.from_id = hit.id) SELECT id FROM hit")
def _(t):
    return reach(t.spark.range(1).select(F.lit("turn:0:1").alias("id")), G.turn_edges(t, cycle=True))


_IMPL = f"{_NE} SELECT id, type, payload FROM nodes WHERE id IN (SELECT from_id FROM edges JOIN nodes n ON n.id = to_id WHERE edge_type = 'implements_trait' AND n.type = 'trait' AND contains(n.payload, 'Brand#2')) ORDER BY id LIMIT 500"


@_query("implementors_substring", _IMPL)
def _(t):
    return Q.trait_implementors(G.nodes(t), G.edges(t), "Brand#2")


_MODULES = f"""{_NE} SELECT from_id, to_id, a.type AS from_type, b.type AS to_type FROM edges JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id
WHERE edge_type = 'contains' AND a.type IN ('file', 'module', 'crate_root') AND b.type IN ('file', 'module')"""


@_query("module_graph_all", f"{_MODULES} ORDER BY from_id, to_id LIMIT 10000")
def _(t):
    return Q.module_graph(G.nodes(t), G.edges(t))


@_query("module_graph_prefix", f"{_MODULES} AND (starts_with(from_id, 'nation:1') OR starts_with(to_id, 'nation:1')) ORDER BY from_id, to_id LIMIT 10000")
def _(t):
    return Q.module_graph(G.nodes(t), G.edges(t), "nation:1")


@_query("changes_with_pairs", "WITH f AS (SELECT DISTINCT l_orderkey AS c, './part/' || l_partkey || '.rs' AS p FROM lineitem) SELECT DISTINCT a.p AS from_id, b.p AS to_id, 'changes_with' AS edge_type FROM f a JOIN f b ON a.c = b.c AND a.p < b.p")
def _(t):
    return Q.change_coupling(G.order_commits(t))


# Resolution


@_query("resolve_calls", G.resolve_sql(True))
def _(t):
    return resolve_calls(G.raw_functions(t), G.raw_placeholders(t, "calls"))


@_query("resolve_refs", G.resolve_sql(False))
def _(t):
    return resolve_names(G.raw_functions(t), G.raw_placeholders(t, "references", qualified=False), "references", ("function",))


@_query("canonical_name", f"{_N} SELECT id, regexp_replace(payload, '^((pub|test|bench)::)+', '') AS name FROM nodes WHERE type = 'function'")
def _(t):
    return G.nodes(t).where("type = 'function'").select("id", canonical_name(F.col("payload")).alias("name"))


@_query("module_paths", "SELECT p_partkey, 'crate::' || p_brand || '::' || p_size AS module FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'crate::' || p_brand FROM part WHERE p_size % 2 = 1")
def _(t):
    rel = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/"), F.col("p_size").cast("string"))).otherwise(F.lit("/mod"))
    return t.part.select("p_partkey", module_path(F.concat(F.lit("./src/"), F.col("p_brand"), rel, F.lit(".rs"))).alias("module"))


_USES = """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'crate::m' WHEN 1 THEN 'crate' ELSE 'crate::m' || p_size % 7 END AS module,
  CASE p_size % 6 WHEN 0 THEN 'crate::' || p_name WHEN 1 THEN 'super::b::' || p_name WHEN 2 THEN 'self::' || p_name WHEN 3 THEN 'crate::b::' || p_name WHEN 4 THEN 'std::x' ELSE 'super' END AS use_path FROM part"""


@_query(
    "use_targets",
    f"""WITH u AS ({_USES}) SELECT p_partkey, CASE
  WHEN use_path = 'super' THEN 'crate' WHEN starts_with(use_path, 'super::') THEN 'crate::b'
  WHEN starts_with(use_path, 'self::') THEN module || '::' || substr(use_path, 7)
  WHEN starts_with(use_path, 'crate::b::') THEN 'crate::crate::b' ELSE use_path END AS target,
  CASE WHEN len(string_split(use_path, '::')) > 2 THEN split_part(use_path, '::', -1) END AS item FROM u WHERE use_path != 'std::x'""",
)
def _(t):
    size, name = F.col("p_size"), F.col("p_name")
    module = F.when(size % 3 == 0, "crate::m").when(size % 3 == 1, "crate").otherwise(F.concat(F.lit("crate::m"), (size % 7).cast("string")))
    path = F.when(size % 6 == 0, F.concat(F.lit("crate::"), name)).when(size % 6 == 1, F.concat(F.lit("super::b::"), name)).when(size % 6 == 2, F.concat(F.lit("self::"), name))
    path = path.when(size % 6 == 3, F.concat(F.lit("crate::b::"), name)).when(size % 6 == 4, "std::x").otherwise("super")
    return use_targets(t.part.select("p_partkey", module.alias("module"), path.alias("use_path"))).select("p_partkey", "target", "item")


# Extraction and the whole pipeline on a small project

PROJECT = {
    "./src/lib.rs": "mod shapes;\npub mod util;\n\npub trait Area {\n    fn area(&self) -> f64;\n}\n\n#[test]\nfn checks() {\n    assert!(helper(2) > 1);\n}\n\nfn helper(n: u32) -> u32 {\n    util::twice(n)\n}\n",
    "./src/shapes.rs": "use super::util::twice;\n\npub struct Square(u32);\n\nimpl Area for Square {\n    fn area(&self) -> f64 {\n        unsafe { raw() }\n        twice(self.0) as f64\n    }\n}\n\nunsafe fn raw() {}\n",
    "./src/util.rs": "macro_rules! double {\n    ($x:expr) => { $x * 2 };\n}\n\npub fn twice(n: u32) -> u32 {\n    double!(n)\n}\n\nfn unused() {}\n",
}


def _values(columns: str, rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"


# Worked out by hand from the sources above.
PROJECT_NODES = [
    ("./src/lib.rs", "file", None), ("./src/lib.rs#1:1", "module", "shapes"), ("./src/lib.rs#2:1", "module", "util"), ("./src/lib.rs#4:1", "trait", "Area"), ("./src/lib.rs#9:1", "function", "test::checks"), ("./src/lib.rs#13:1", "function", "helper"),
    ("./src/shapes.rs", "file", None), ("./src/shapes.rs#3:1", "struct", "Square"), ("./src/shapes.rs#5:1", "impl", "Area"), ("./src/shapes.rs#6:5", "function", "area"), ("./src/shapes.rs#12:1", "function", "raw"),
    ("./src/util.rs", "file", None), ("./src/util.rs#1:1", "macro", "double"), ("./src/util.rs#5:1", "function", "pub::twice"), ("./src/util.rs#9:1", "function", "unused"),
]
PROJECT_EDGES = [
    *[("./src/lib.rs", f"./src/lib.rs#{p}", "contains") for p in ("1:1", "2:1", "4:1", "9:1", "13:1")],
    *[("./src/shapes.rs", f"./src/shapes.rs#{p}", "contains") for p in ("3:1", "5:1", "12:1")], ("./src/shapes.rs#5:1", "./src/shapes.rs#6:5", "contains"),
    *[("./src/util.rs", f"./src/util.rs#{p}", "contains") for p in ("1:1", "5:1", "9:1")],
    ("./src/lib.rs#9:1", "./src/lib.rs#13:1", "calls"), ("./src/shapes.rs#6:5", "./src/shapes.rs#12:1", "calls"), ("./src/shapes.rs#6:5", "./src/util.rs#5:1", "calls"),
    ("./src/lib.rs#4:1", "./src/lib.rs#4:1", "references"), ("./src/shapes.rs#3:1", "./src/shapes.rs#3:1", "references"), ("./src/shapes.rs#5:1", "./src/lib.rs#4:1", "references"), ("./src/shapes.rs#5:1", "./src/shapes.rs#3:1", "references"),
    ("./src/shapes.rs#5:1", "./src/lib.rs#4:1", "implements_trait"), ("./src/util.rs#5:1", "./src/util.rs#1:1", "expands_to"),
    ("./src/shapes.rs#6:5", "./src/shapes.rs#6:5", "uses_unsafe"), ("./src/shapes.rs#12:1", "./src/shapes.rs#12:1", "uses_unsafe"),
    ("./src/shapes.rs", "./src/util.rs#5:1", "imports"),
]
PROJECT_DEAD = [("./src/shapes.rs#6:5",), ("./src/shapes.rs#12:1",), ("./src/util.rs#9:1",)]


def _project(t: G.Tables) -> DataFrame:
    return t.spark.createDataFrame(list(PROJECT.items()), "file_id string, content string")


@_query("extract_nodes", _values("id, type, payload", PROJECT_NODES))
def _(t):
    return raw_nodes(extract(_project(t)))


@_query("index_edges", _values("from_id, to_id, edge_type", PROJECT_EDGES))
def _(t):
    return build_graph(_project(t))[1]


@_query("index_dead", _values("id", PROJECT_DEAD))
def _(t):
    return build_graph(_project(t))[2]


@_query("index_imports", _values("from_id, to_id, edge_type", [e for e in PROJECT_EDGES if e[2] == "imports"]))
def _(t):
    facts = extract(_project(t))
    return resolve_imports(raw_nodes(facts), raw_edges(facts), use_paths(facts))


@_query("file_modules", _values("file_id, module", [("./src/lib.rs", "crate"), ("./src/shapes.rs", "crate::shapes"), ("./src/util.rs", "crate::util")]))
def _(t):
    return file_modules(raw_nodes(extract(_project(t))))


# Datalog: each script must equal a query above


def _script(t: G.Tables, script: str, params: dict | None = None, turns: bool = False) -> DataFrame:
    tables = {"nodes": G.turn_nodes(t), "edges": G.turn_edges(t, cycle=True)} if turns else {"nodes": G.nodes(t), "edges": G.edges(t)}
    return run_script(t.spark, tables, script, params)


@_query("datalog_join", _IMPL)
def _(t):
    return _script(t, '?[id, type, payload] := *nodes[tr, kind, name], kind = "trait", not(is_null(name)), str_includes(name, $name), *edges[id, tr, "implements_trait"], *nodes[id, type, payload]\n:limit 500', {"name": "Brand#2"})


@_query("datalog_negation", _dead_sql(_NE))
def _(t):
    return _script(
        t,
        """entry[id] := *nodes[id, "function", p], (p == "main" or starts_with(p, "pub::") or starts_with(p, "test::") or starts_with(p, "bench::"))
        live[id] := entry[id]
        live[to] := live[from], *edges[from, to, kind], kind in ["calls", "references"]
        ?[id] := *nodes[id, type, _], type = "function", not live[id]""",
    )


@_query("datalog_recursion", _callers_sql(_C, "turn:0:2", 20))
def _(t):
    return _script(
        t,
        """up[caller, d] := *edges[caller, callee, "calls"], callee = $target, d = 1
        up[caller, e] := *edges[caller, prev, "calls"], up[prev, d], e = d + 1, e <= 20
        ?[id, type, payload] := up[id, _], *nodes[id, type, payload], id != $target
        :limit 500""",
        {"target": "turn:0:2"},
        turns=True,
    )


@_query("datalog_count", f"{_NE} SELECT edge_type AS et, count(*) AS n FROM edges GROUP BY edge_type")
def _(t):
    return _script(t, "pair[et, f, b] := *edges[f, b, et]\n?[et, count(f)] := pair[et, f, b]").toDF("et", "n")


@_query("datalog_inline", _values("x, y", [("b", "c"), ("c", "d")]))
def _(t):
    return _script(t, 'e[x, y] <- [["a", "b"], ["b", "c"], ["c", "d"]]\n?[x, y] := e[x, y], x != "a"')


@_query("datalog_page", f"{_N} SELECT id FROM nodes WHERE type = 'module' ORDER BY id LIMIT 5 OFFSET 3")
def _(t):
    return _script(t, '?[id] := *nodes[id, "module", _]\n:limit 5\n:offset 3')
