"""Questions to the code graph. Results are ordered by id before any limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import is_entry
from .reach import reach

RESULT_LIMIT, MODULE_LIMIT, MAX_DEPTH = 500, 10_000, 100
NEIGHBOURS = ("calls", "contains", "references", "changes_with")
FOLLOWED = ("calls", "references", "changes_with")


def of_types(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*types))


def dead_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` of functions that no entry point reaches over calls and references."""
    functions = nodes.where("type = 'function'")
    alive = reach(functions.where(is_entry(F.col("payload"))).select("id"), of_types(edges, "calls", "references"))
    return functions.select("id").join(alive, "id", "left_anti").distinct()


def blast_radius(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = RESULT_LIMIT) -> DataFrame:
    """Nodes that a change may touch: neighbours both ways, then forward without containment."""
    near = of_types(edges, *NEIGHBOURS)
    seeds = near.where(F.col("from_id") == node_id).select(F.col("to_id").alias("id")).union(near.where(F.col("to_id") == node_id).select(F.col("from_id").alias("id")))
    found = reach(seeds, of_types(edges, *FOLLOWED)).where(F.col("id") != node_id)
    return nodes.join(found, "id", "left_semi").select("id", "type", "payload").orderBy("id").limit(limit)


def callers(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1, limit: int = RESULT_LIMIT) -> DataFrame:
    """Nodes that call ``node_id`` over at most ``depth`` calls (1 to MAX_DEPTH)."""
    back = of_types(edges, "calls").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    direct = back.where(F.col("from_id") == node_id).select(F.col("to_id").alias("id"))
    found = reach(direct, back, min(max(depth, 1), MAX_DEPTH) - 1).where(F.col("id") != node_id)
    return nodes.join(found, "id", "left_semi").select("id", "type", "payload").orderBy("id").limit(limit)


def edges_out(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """``id, edge_type, node_type, payload`` of what ``node_id`` points to."""
    ends = nodes.select("id", F.col("type").alias("node_type"), "payload")
    return edges.where(F.col("from_id") == node_id).select(F.col("to_id").alias("id"), "edge_type").join(ends, "id")


def edges_in(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """``id, edge_type, node_type, payload`` of what points to ``node_id``."""
    ends = nodes.select("id", F.col("type").alias("node_type"), "payload")
    return edges.where(F.col("to_id") == node_id).select(F.col("from_id").alias("id"), "edge_type").join(ends, "id")


def node_info(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One row with the node and its edges as lists, or none if it doesn't exist."""
    gather = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct("id", "edge_type", "node_type", "payload"))).alias(name)).withColumn("id", F.lit(node_id))
    node = nodes.where(F.col("id") == node_id).select("id", F.col("type").alias("node_type"), "payload")
    return node.join(gather(edges_out(nodes, edges, node_id), "outgoing_edges"), "id").join(gather(edges_in(nodes, edges, node_id), "incoming_edges"), "id")


def trait_implementors(nodes: DataFrame, edges: DataFrame, name: str, limit: int = RESULT_LIMIT) -> DataFrame:
    """Nodes with an ``implements_trait`` edge to a trait whose name contains ``name``."""
    traits = nodes.where((F.col("type") == "trait") & F.col("payload").contains(name)).select(F.col("id").alias("to_id"))
    impls = of_types(edges, "implements_trait").join(traits, "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    return nodes.join(impls, "id", "left_semi").select("id", "type", "payload").orderBy("id").limit(limit)


def module_graph(nodes: DataFrame, edges: DataFrame, prefix: str | None = None, limit: int = MODULE_LIMIT) -> DataFrame:
    """Containment among crates, files and modules; with a prefix, edges with an end below it."""
    start = nodes.where(F.col("type").isin("file", "module", "crate_root")).select(F.col("id").alias("from_id"), F.col("type").alias("from_type"))
    end = nodes.where(F.col("type").isin("file", "module")).select(F.col("id").alias("to_id"), F.col("type").alias("to_type"))
    out = of_types(edges, "contains").join(start, "from_id").join(end, "to_id")
    if prefix:
        out = out.where(F.col("from_id").startswith(prefix) | F.col("to_id").startswith(prefix))
    return out.select("from_id", "to_id", "from_type", "to_type").orderBy("from_id", "to_id").limit(limit)


def search_matches(nodes: DataFrame, query: str, case_insensitive: bool = False) -> DataFrame:
    """Nodes whose payload contains ``query``; a null payload never does."""
    text = F.lower("payload") if case_insensitive else F.col("payload")
    return nodes.where(F.col("payload").isNotNull() & text.contains(query.lower() if case_insensitive else query)).select("id", "type", "payload")


def text_search(nodes: DataFrame, query: str, case_insensitive: bool = False, limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """(a page of matches, how many there are in all)."""
    found = search_matches(nodes, query, case_insensitive)
    return found.orderBy("id").offset(offset).limit(limit), found.count()


def change_coupling(commits: DataFrame) -> DataFrame:
    """``changes_with`` edges between ``.rs`` files of one commit, the smaller path first."""
    files = commits.where(F.col("path").endswith(".rs")).select("commit_id", F.concat(F.lit("./"), F.regexp_replace("path", r"^\./", "")).alias("path")).distinct()
    pairs = files.alias("a").join(files.alias("b"), "commit_id").where("a.path < b.path")
    return pairs.select(F.col("a.path").alias("from_id"), F.col("b.path").alias("to_id"), F.lit("changes_with").alias("edge_type")).distinct()
