"""Named queries that run the graph store and the tools over the projected graph."""

from __future__ import annotations

import io
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import EDGES, NODES
from ..sources.shared import shared_dir
from ..sources.store import GraphStore
from . import relational_graph as G
from .indexing import build_graph
from .registry import _C, _IMPL, _MODULES, _N, _NE, _blast_sql, _callers_sql, _dead_sql, _query, _values
from .service import Service, respond

_T = f"WITH RECURSIVE {G.TURNS_SQL}"


def _store(t: G.Tables, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> GraphStore:
    """A store in the shared folder with these tables."""
    store = GraphStore(t.spark, f"{shared_dir(t.spark)}/graph")
    store.replace(nodes, edges)
    return store


def _service(t: G.Tables, turns: bool = False) -> Service:
    store = _store(t, G.turn_nodes(t), G.turn_edges(t, cycle=True)) if turns else _store(t, G.nodes(t), G.edges(t))
    return Service(t.spark, store.path)


def _triples(t: G.Tables, found: list[dict]) -> DataFrame:
    return t.spark.createDataFrame([(r["id"], r["type"], r["payload"]) for r in found], NODES)


# The store


@_query("store_put_nodes", f"{_N} SELECT id, CASE WHEN id = 'part:7' THEN 'struct' ELSE type END AS type, CASE WHEN id = 'part:7' THEN 'second' ELSE payload END AS payload FROM nodes UNION ALL SELECT 'own:1', 'function', NULL UNION ALL SELECT 'own:2', 'file', 'p'")
def _(t):
    store = _store(t, G.nodes(t))
    store.put_nodes([("part:7", "struct", "first"), ("own:1", "function", "gone"), ("part:7", "struct", "second")])
    store.put_node("own:1", "function")
    store.put_node("own:2", "file", "p")
    return store.nodes


@_query("store_put_edges", f"{_NE} SELECT * FROM edges UNION SELECT 'own:1', 'own:2', 'calls' UNION SELECT 'own:2', 'own:1', 'owns'")
def _(t):
    store = _store(t, edges=G.edges(t))
    store.put_edges([("own:1", "own:2", "calls")] * 2 + [("own:2", "own:1", "owns")])
    again = [tuple(r) for r in store.edges.orderBy("from_id", "to_id", "edge_type").limit(3).collect()]
    store.put_edges(again)
    store.put_edge("own:1", "own:2", "calls")
    return store.edges


@_query("store_remove_edge", f"{_NE} SELECT * FROM edges EXCEPT (SELECT * FROM edges ORDER BY from_id, to_id, edge_type LIMIT 2)")
def _(t):
    store = _store(t, edges=G.edges(t))
    for r in store.edges.orderBy("from_id", "to_id", "edge_type").limit(2).collect():
        store.remove_edge(*r)
    store.remove_edge("no", "such", "calls")
    return store.edges


@_query("store_counts", f"{_NE} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, 0 AS nodes_after, 0 AS edges_after, 0 AS dead_after")
def _(t):
    store = _store(t, G.nodes(t), G.edges(t))
    store.put_dead(["part:1"])
    before = store.node_count(), store.edge_count()
    store.clear()
    return t.spark.createDataFrame([(*before, store.node_count(), store.edge_count(), store.dead_functions.count())], "nodes long, edges long, nodes_after int, edges_after int, dead_after int")


@_query("store_dead", _values("id", [("part:2",), ("part:3",)]))
def _(t):
    store = _store(t)
    store.put_dead(["part:1", "part:2"])
    store.clear_dead()
    store.put_dead(["part:2", "part:3", "part:2"])
    store.put_dead([])
    return GraphStore(t.spark, store.path).dead_functions


@_query("store_copy", f"{_N} SELECT id, type, payload FROM nodes UNION ALL SELECT 'own:1', 'function', 'kept'")
def _(t):
    """Rows of unknown types aren't copied, and nodes that both stores have become the other's."""
    other = _store(t, G.nodes(t).unionByName(t.spark.createDataFrame([("own:3", "no_such_type", None)], NODES)))
    store = _store(t, t.spark.createDataFrame([("own:1", "function", "kept"), ("part:7", "function", "old")], NODES), t.spark.createDataFrame([], EDGES))
    store.copy_from(other)
    return store.nodes


# The tools, with their defaults, caps and paging


@_query("tool_search", f"{_N}, found AS (SELECT * FROM nodes WHERE contains(lower(payload), 'ring')) SELECT id, type, payload, (SELECT count(*) FROM found) AS total, 7 AS from_row, 25 AS page FROM found ORDER BY id LIMIT 25 OFFSET 7")
def _(t):
    answer = _service(t).call("search", {"query": "RING", "case_insensitive": True, "offset": 7, "limit": 25})
    return _triples(t, answer["results"]).select("*", F.lit(answer["total"]).cast("long").alias("total"), F.lit(answer["offset"]).alias("from_row"), F.lit(answer["limit"]).alias("page"))


@_query("tool_search_caps", f"{_N} SELECT count(*) AS total, least(count(*), 100) AS by_default, least(count(*), 10000) AS capped, 10000 AS cap, 100 AS negative FROM nodes WHERE contains(payload, 'r')")
def _(t):
    service = _service(t)
    plain, large, odd = (service.call("search", {"query": "r"} | more) for more in ({}, {"limit": 10**9}, {"limit": -5, "offset": "x"}))
    return t.spark.createDataFrame([(plain["total"], plain["count"], large["count"], large["limit"], odd["limit"])], "total long, by_default long, capped long, cap int, negative int")


@_query("tool_dead_code", f"{_dead_sql(_NE, ' AND regexp_full_match(id, ' + chr(39) + 'orders:1.*' + chr(39) + ')')} ORDER BY id LIMIT 10 OFFSET 5")
def _(t):
    found = _service(t).call("dead_code", {"file": "orders:1*", "node_type": "function", "offset": 5, "limit": 10})
    return t.spark.createDataFrame([(i,) for i in found["dead_node_ids"]], "id string")


@_query("tool_dead_code_stored", "SELECT 'part:2' AS id, 2 AS total, 'stored' AS source")
def _(t):
    service = _service(t)
    service.store.put_dead(["part:1", "part:2"])
    found = service.call("dead_code", {"offset": 1})
    return t.spark.createDataFrame([(i, found["total_filtered"], found["source"]) for i in found["dead_node_ids"]], "id string, total int, source string")


@_query("tool_blast_radius", _blast_sql("orders:5"))
def _(t):
    return _triples(t, _service(t).call("blast_radius", {"node_id": "orders:5"})["reachable_nodes"])


@_query("tool_callers", _callers_sql(_C, "turn:0:2", 100))
def _(t):
    """A depth over the cap counts as the cap."""
    return _triples(t, _service(t, turns=True).call("callers", {"node_id": "turn:0:2", "depth": 1000})["callers"])


@_query("tool_node_info", f"{_NE} SELECT 'out' AS side, to_id AS id, edge_type, type AS node_type, payload FROM edges JOIN nodes n ON n.id = to_id WHERE from_id = 'part:7' UNION ALL SELECT 'in', from_id, edge_type, type, payload FROM edges JOIN nodes n ON n.id = from_id WHERE to_id = 'part:7'")
def _(t):
    info = _service(t).call("node_info", {"node_id": "part:7"})
    rows = [(side, r["id"], r["edge_type"], r["node_type"], r.get("payload")) for side, key in (("out", "outgoing_edges"), ("in", "incoming_edges")) for r in info[key]]
    return t.spark.createDataFrame(rows, "side string, id string, edge_type string, node_type string, payload string")


@_query("tool_trait_implementors", _IMPL)
def _(t):
    return _triples(t, _service(t).call("trait_implementors", {"trait_name": "Brand#2"})["implementors"])


@_query("tool_module_graph", f"{_MODULES} AND (starts_with(from_id, 'nation:1') OR starts_with(to_id, 'nation:1')) ORDER BY from_id, to_id LIMIT 10000")
def _(t):
    rows = _service(t).call("module_graph", {"root": "nation:1"})["edges"]
    return t.spark.createDataFrame([(r["from_id"], r["to_id"], r["from_type"], r["to_type"]) for r in rows], "from_id string, to_id string, from_type string, to_type string")


@_query("tool_status", f"{_NE} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, true AS dated")
def _(t):
    """Through the server's resource."""
    answer = respond(_service(t), {"id": 1, "method": "resources/read", "params": {"uri": "tessera://status"}})
    status = json.loads(answer["result"]["contents"][0]["text"])
    return t.spark.createDataFrame([(status["node_count"], status["edge_count"], status["indexed_at"] > 0)], "node_count long, edge_count long, dated boolean")


@_query("tool_query", f"{_N} SELECT id, payload FROM nodes WHERE type = 'module' ORDER BY id LIMIT 4")
def _(t):
    """The request's limit replaces the script's own."""
    answer = _service(t).call("query", {"script": '?[id, payload] := *nodes[id, "module", payload]\n: LIMIT 999\n:limit 2', "limit": 4})
    return t.spark.createDataFrame([tuple(r) for r in answer["rows"]], "id string, payload string")


@_query("tool_query_refuses", _values("script, refused", [(":put nodes {id}", "true"), (": RM edges {id}", "true"), (":replace[x]", "true"), (":create t", "true"), (":putter", "false")]))
def _(t):
    from .service import InvalidParams, clean_script

    rows = []
    for script in (":put nodes {id}", ": RM edges {id}", ":replace[x]", ":create t", ":putter"):
        try:
            clean_script(script, 1)
            rows.append((script, "false"))
        except InvalidParams:
            rows.append((script, "true"))
    return t.spark.createDataFrame(rows, "script string, refused string")


@_query("cli_query", f"{_N} SELECT type || chr(9) || id AS line FROM nodes WHERE starts_with(id, 'nation:')")
def _(t):
    """The command line's own script runner, printing tab-separated lines."""
    from .cli import main

    out = io.StringIO()
    store = _store(t, G.nodes(t), G.edges(t))
    main(["query", "-d", store.path, '?[type, id] := *nodes[id, type, _], starts_with(id, "nation:")'], spark=t.spark, out=out)
    lines = out.getvalue().splitlines()
    return t.spark.createDataFrame([(x,) for x in lines if "nation:" in x], "line string")


# A workspace of two crates, with the kinds of items that the small project lacks

WORKSPACE = {
    "./crate_a/src/lib.rs": "pub mod inner;\n\npub const MAX: u32 = 3;\nstatic NAME: &str = \"a\";\ntype Pair = (u32, u32);\n\npub enum Kind {\n    One,\n    Two(u32),\n}\n\npub fn start(k: Kind) -> Pair {\n    inner::step();\n    shared(1)\n}\n\nfn shared(n: u32) -> Pair {\n    (n, n)\n}\n",
    "./crate_a/src/inner.rs": "#[allow(unused)]\n#[bench]\nfn speed(b: &mut Bencher) {\n    b.iter(|| step());\n}\n\npub fn step() {}\n",
    "./crate_b/src/main.rs": "pub trait Run {\n    fn run(&self);\n}\n\nstruct Job<T>(T);\n\nimpl<T> Run for Job<T> {\n    fn run(&self) {\n        only_here();\n    }\n}\n\nfn only_here() {}\n\nfn main() {\n    start(Kind::One);\n    missing();\n}\n",
}
# Worked out by hand from the sources above.
WORKSPACE_NODES = [
    ("./crate_a/src/lib.rs", "file", None), ("./crate_a/src/lib.rs#1:1", "module", "inner"), ("./crate_a/src/lib.rs#3:1", "const", "MAX"), ("./crate_a/src/lib.rs#4:1", "static", "NAME"), ("./crate_a/src/lib.rs#5:1", "type_alias", "Pair"),
    ("./crate_a/src/lib.rs#7:1", "enum", "Kind"), ("./crate_a/src/lib.rs#12:1", "function", "pub::start"), ("./crate_a/src/lib.rs#17:1", "function", "shared"),
    ("./crate_a/src/inner.rs", "file", None), ("./crate_a/src/inner.rs#3:1", "function", "bench::speed"), ("./crate_a/src/inner.rs#7:1", "function", "pub::step"),
    ("./crate_b/src/main.rs", "file", None), ("./crate_b/src/main.rs#1:1", "trait", "Run"), ("./crate_b/src/main.rs#5:1", "struct", "Job"), ("./crate_b/src/main.rs#7:1", "impl", "Run"),
    ("./crate_b/src/main.rs#8:5", "function", "run"), ("./crate_b/src/main.rs#13:1", "function", "only_here"), ("./crate_b/src/main.rs#15:1", "function", "main"),
]
WORKSPACE_CALLS = [
    ("./crate_a/src/lib.rs#12:1", "./crate_a/src/lib.rs#17:1"), ("./crate_a/src/inner.rs#3:1", "./crate_a/src/inner.rs#7:1"),
    ("./crate_b/src/main.rs#8:5", "./crate_b/src/main.rs#13:1"), ("./crate_b/src/main.rs#15:1", "./crate_a/src/lib.rs#12:1"),
]


def _workspace(t: G.Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return build_graph(t.spark.createDataFrame(list(WORKSPACE.items()), "file_id string, content string"))


@_query("workspace_nodes", _values("id, type, payload", WORKSPACE_NODES))
def _(t):
    return _workspace(t)[0]


@_query("workspace_calls", _values("from_id, to_id", WORKSPACE_CALLS))
def _(t):
    return _workspace(t)[1].where("edge_type = 'calls'").select("from_id", "to_id")


@_query("workspace_dead", _values("id", [("./crate_b/src/main.rs#8:5",), ("./crate_b/src/main.rs#13:1",)]))
def _(t):
    return _workspace(t)[2]


@_query("reindexed_status", "SELECT 3 AS files, 18 AS nodes")
def _(t):
    """A project in files, indexed by the tool, as other readers of the store see it."""
    import tempfile

    with tempfile.TemporaryDirectory() as root:
        for path, text in WORKSPACE.items():
            full = os.path.join(root, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w", encoding="utf-8") as f:
                f.write(text)
        service = Service(t.spark, f"{shared_dir(t.spark)}/graph")
        service.call("reindex", {"path": root})
        nodes = GraphStore(t.spark, service.db_path).nodes
        return t.spark.createDataFrame([(nodes.where("type = 'file'").count(), nodes.count())], "files int, nodes int")
