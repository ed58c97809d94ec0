"""The ten tools and the status resource, as functions over a graph store, and a stdio server."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import glob_regex, json_value
from ..operators import graph_queries as Q
from ..sources.store import GraphStore
from .datalog import run_script
from .indexing import index

DEFAULT_LIMIT, LIMIT_CAP, DEPTH_CAP = 100, 10_000, 100
DB_VARIABLE, DB_NAME = "TESSERA_DB", ".tessera"
STATUS_URI = "tessera://status"
MUTATIONS = (":put", ":rm", ":create", ":replace", ":remove")


class InvalidParams(ValueError):
    """A request lacks an argument or has a bad one."""


def _whole(args: dict, name: str, default: int, cap: int | None = None) -> int:
    value = args.get(name)
    n = value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default
    return n if cap is None else min(n, cap)


def _text(args: dict, name: str, required: bool = True) -> str | None:
    value = args.get(name)
    if isinstance(value, str):
        return value
    if required:
        raise InvalidParams(f"missing required parameter: {name}")
    return None


def _triples(df: DataFrame) -> list[dict]:
    return [{"id": r["id"], "type": r["type"], "payload": r["payload"]} for r in df.orderBy("id").collect()]


def clean_script(script: str, limit: int) -> str:
    """The script with its own limits replaced by ``limit``; directives that would write are refused."""
    kept = []
    for line in script.splitlines():
        norm = line.strip().lower()
        while ": " in norm:
            norm = norm.replace(": ", ":")
        for m in MUTATIONS:
            after = norm.removeprefix(m)
            if norm.startswith(m) and (not after or after[0].isspace() or after[0] == "["):
                raise InvalidParams(f"scripts only read: {m} is refused")
        after = norm.removeprefix(":limit")
        if not norm.startswith(":limit") or after and not (after[0].isspace() or after[0].isdigit()):
            kept.append(line)
    return "\n".join(kept).strip() + f"\n:limit {limit}"


class Service:
    """Answers tool calls; the store of a path is opened once."""

    def __init__(self, spark: SparkSession, db_path: str | None = None) -> None:
        self.spark = spark
        self.db_path = db_path or os.environ.get(DB_VARIABLE) or os.path.join(os.getcwd(), DB_NAME)
        self._store: GraphStore | None = None

    @property
    def store(self) -> GraphStore:
        if self._store is None:
            self._store = GraphStore(self.spark, self.db_path)
        return self._store

    def call(self, tool: str, args: dict | None = None) -> dict:
        """Result of a tool. Errors: FileNotFoundError without a graph, InvalidParams, KeyError for no such tool."""
        if tool != "reindex" and self._store is None and not GraphStore.exists(self.spark, self.db_path):
            raise FileNotFoundError(f"no graph at {self.db_path}; index a project first")
        if tool not in TOOLS:
            raise KeyError(f"Unknown tool: {tool}")
        return getattr(self, tool)(args or {})

    def dead_code(self, args: dict) -> dict:
        ids, source = self.store.dead_functions, "stored"
        if ids.isEmpty():
            ids, source = Q.dead_functions(self.store.nodes, self.store.edges), "computed"
        pattern, node_type = _text(args, "file", False), _text(args, "node_type", False)
        if pattern is not None:
            try:
                ids = ids.where(F.col("id").rlike(glob_regex(pattern)))
            except ValueError as e:
                raise InvalidParams(f"Invalid glob pattern: {e}") from e
        if node_type is not None:
            ids = ids.join(self.store.nodes.where(F.col("type") == node_type), "id", "left_semi")
        offset, limit = _whole(args, "offset", 0), _whole(args, "limit", DEFAULT_LIMIT, LIMIT_CAP)
        page = [r["id"] for r in ids.orderBy("id").offset(offset).limit(limit).collect()]
        return {"dead_node_ids": page, "count": len(page), "total_filtered": ids.count(), "offset": offset, "limit": limit, "source": source}

    def blast_radius(self, args: dict) -> dict:
        node = _text(args, "node_id")
        found = _triples(Q.blast_radius(self.store.nodes, self.store.edges, node))
        return {"from_node_id": node, "reachable_nodes": found, "count": len(found)}

    def search(self, args: dict) -> dict:
        offset, limit = _whole(args, "offset", 0), _whole(args, "limit", DEFAULT_LIMIT, LIMIT_CAP)
        page, total = Q.text_search(self.store.nodes, _text(args, "query"), args.get("case_insensitive") is True, limit, offset)
        results = _triples(page)
        return {"results": results, "count": len(results), "total": total, "offset": offset, "limit": limit}

    def status(self, args: dict | None = None) -> dict:
        return {"node_count": self.store.node_count(), "edge_count": self.store.edge_count(), "db_path": self.db_path, "indexed_at": self.store.indexed_at()}

    def query(self, args: dict) -> dict:
        script = clean_script(_text(args, "script"), _whole(args, "limit", DEFAULT_LIMIT, LIMIT_CAP))
        answer = run_script(self.spark, {"nodes": self.store.nodes, "edges": self.store.edges, "dead_functions": self.store.dead_functions}, script)
        rows = [[json_value(x) for x in r] for r in answer.collect()]
        return {"headers": answer.columns, "rows": rows, "count": len(rows)}

    def callers(self, args: dict) -> dict:
        node = _text(args, "node_id")
        found = _triples(Q.callers(self.store.nodes, self.store.edges, node, _whole(args, "depth", 1, DEPTH_CAP)))
        return {"node_id": node, "callers": found, "count": len(found)}

    def node_info(self, args: dict) -> dict:
        node = _text(args, "node_id")
        row = Q.node_info(self.store.nodes, self.store.edges, node).first()
        if row is None:
            return {"error": "Node not found", "node_id": node}
        present = lambda d: {k: v for k, v in d.items() if not (k == "payload" and v is None)}
        ends = lambda rows: [present(r.asDict()) for r in rows]
        return present({"id": row["id"], "node_type": row["node_type"], "payload": row["payload"]}) | {"outgoing_edges": ends(row["outgoing_edges"]), "incoming_edges": ends(row["incoming_edges"])}

    def trait_implementors(self, args: dict) -> dict:
        name = _text(args, "trait_name")
        try:
            found, note = _triples(Q.trait_implementors(self.store.nodes, self.store.edges, name)), {}
        except PySparkException as e:
            found, note = [], {"note": f"The graph couldn't be asked, so implementors may be missing: {e.getCondition() or type(e).__name__}"}
        return {"trait_name": name, "implementors": found, "count": len(found)} | note

    def module_graph(self, args: dict) -> dict:
        rows = [r.asDict() for r in Q.module_graph(self.store.nodes, self.store.edges, _text(args, "root", False)).collect()]
        return {"edges": rows, "count": len(rows)}

    def reindex(self, args: dict) -> dict:
        root = _text(args, "path", False) or os.getcwd()
        if not os.path.exists(root):
            return {"error": "there is no such folder", "path": root}
        index(self.spark, root, self.store)
        return {"ok": True, "message": "the project is indexed", "path": root, "db_path": self.db_path, "node_count": self.store.node_count(), "edge_count": self.store.edge_count(), "indexed_at": int(time.time())}


def _schema(required: tuple[str, ...] = (), **properties: str) -> dict:
    return {"type": "object", "properties": {k: {"type": v} for k, v in properties.items()}, "required": list(required)}


TOOLS = {
    "dead_code": ("Functions that no entry point reaches; filter by glob or type, with paging.", _schema(file="string", node_type="string", limit="integer", offset="integer")),
    "blast_radius": ("Nodes that a change of a node may touch.", _schema(("node_id",), node_id="string")),
    "search": ("Nodes whose name contains a text.", _schema(("query",), query="string", case_insensitive="boolean", limit="integer", offset="integer")),
    "status": ("Size and age of the graph.", _schema()),
    "query": ("Run a read-only Datalog script.", _schema(("script",), script="string", limit="integer")),
    "callers": ("Nodes that call a node, directly or over several calls.", _schema(("node_id",), node_id="string", depth="integer")),
    "node_info": ("A node and all its edges.", _schema(("node_id",), node_id="string")),
    "trait_implementors": ("Implementations of a trait by part of its name.", _schema(("trait_name",), trait_name="string")),
    "module_graph": ("Containment of files and modules.", _schema(root="string")),
    "reindex": ("Index the project again.", _schema(path="string")),
}


def respond(service: Service, request: dict) -> dict | None:
    """The JSON-RPC answer to a request, or None to a notification."""
    method, params, rid = request.get("method", ""), request.get("params") or {}, request.get("id")
    if rid is None:
        return None
    fail = lambda code, text: {"jsonrpc": "2.0", "id": rid, "error": {"code": code, "message": text}}
    try:
        if method == "initialize":
            result: dict = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "tessera", "version": "0.1"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s) in TOOLS.items()]}
        elif method == "tools/call":
            value = service.call(params.get("name", ""), params.get("arguments"))
            bad = params.get("name") == "reindex" and "error" in value
            result = {"content": [{"type": "text", "text": json.dumps(value)}], "structuredContent": value, "isError": bad}
        elif method == "resources/list":
            result = {"resources": [{"uri": STATUS_URI, "name": "status", "mimeType": "application/json"}]}
        elif method == "resources/read":
            if params.get("uri") != STATUS_URI:
                return fail(-32002, f"Resource not found: {params.get('uri')}")
            result = {"contents": [{"uri": STATUS_URI, "mimeType": "application/json", "text": json.dumps(service.call("status"))}]}
        else:
            return fail(-32601, f"Method not found: {method}")
    except (InvalidParams, KeyError) as e:
        return fail(-32602, str(e.args[0]))
    except Exception as e:
        return fail(-32603, str(e))
    return {"jsonrpc": "2.0", "id": rid, "result": result}


def serve(service: Service, source=sys.stdin, sink=sys.stdout) -> None:
    """Answer one JSON-RPC request per line until the input ends."""
    for line in source:
        if line.strip():
            try:
                answer = respond(service, json.loads(line))
            except ValueError:
                answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
            if answer is not None:
                sink.write(json.dumps(answer) + "\n")
                sink.flush()
