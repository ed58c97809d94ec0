"""Command line: index, query, search, status, watch, mcp."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from ..functions.vocab import tsv_line
from ..operators.graph_queries import text_search
from ..sources.store import GraphStore
from .datalog import run_script
from .indexing import index
from .service import DB_NAME, Service, serve

ROWS = 10_000


def session() -> SparkSession:
    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _open(spark: SparkSession, path: str | None) -> GraphStore:
    path = path or os.path.join(os.getcwd(), DB_NAME)
    if not GraphStore.exists(spark, path):
        raise SystemExit(f"no graph at {path}; make one with 'index --output {path}'")
    return GraphStore(spark, path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    say = lambda *a: print(*a, file=out)
    parser = argparse.ArgumentParser(prog="tessera", description="Code graph analytics on Spark")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index", help="index a Rust project")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-o", "--output")
    p = sub.add_parser("query", help="run a Datalog script")
    p.add_argument("-d", "--db")
    p.add_argument("query")
    p = sub.add_parser("search", help="find nodes by part of their name")
    p.add_argument("-d", "--db")
    p.add_argument("query")
    p.add_argument("-c", "--case-insensitive", action="store_true")
    p = sub.add_parser("status", help="show the size of a graph")
    p.add_argument("path", nargs="?", default=".")
    p = sub.add_parser("watch", help="index again when files change")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-o", "--output", required=True)
    sub.add_parser("mcp", help="serve the tools over standard input and output")
    args = parser.parse_args(argv)
    spark = spark or session()
    if args.command == "index":
        store = GraphStore(spark, args.output)
        index(spark, args.path, store)
        say(f"Indexed {args.path} into {args.output}" if args.output else f"Indexed {args.path} (in-memory: {store.node_count()} nodes, {store.edge_count()} edges; use --output to persist)")
    elif args.command == "query":
        store = _open(spark, args.db)
        script = args.query.strip() if ":limit" in args.query else f"{args.query.strip()}\n:limit {ROWS}"
        for row in run_script(spark, {"nodes": store.nodes, "edges": store.edges, "dead_functions": store.dead_functions}, script).collect():
            say(tsv_line(tuple(row)))
    elif args.command == "search":
        page, _ = text_search(_open(spark, args.db).nodes, args.query, args.case_insensitive, ROWS)
        for r in page.collect():
            say(f"{r['id']}\t{r['type']}\t{'—' if r['payload'] is None else r['payload']}")
    elif args.command == "status":
        path = os.path.join(args.path, DB_NAME) if os.path.isdir(args.path) and not os.path.exists(os.path.join(args.path, "CURRENT")) else args.path
        if not GraphStore.exists(spark, path):
            say(f"No graph at {path}. Run 'index --output {path}' first.")
            return 0
        store = GraphStore(spark, path)
        say(f"Graph: {path}\n  nodes: {store.node_count()}\n  edges: {store.edge_count()}")
    elif args.command == "watch":
        from ..streaming.watch import watch

        index(spark, args.path, store := GraphStore(spark, args.output))
        say(f"Watching {args.path}. Ctrl+C to stop.")
        query = watch(spark, args.path, store, say=say)
        try:
            query.awaitTermination()
        except KeyboardInterrupt:
            query.stop()
        say("Stopped watching.")
    else:
        serve(Service(spark))
    return 0


if __name__ == "__main__":
    sys.exit(main())
