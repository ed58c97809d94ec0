"""The indexing pipeline: sources to a resolved graph with its dead functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract, raw_edges, raw_nodes, use_paths
from ..operators.graph_queries import change_coupling, dead_functions
from ..operators.modules import resolve_imports
from ..operators.resolve import resolve_calls, resolve_names
from ..sources.git_history import read_history
from ..sources.shared import materialise
from ..sources.source_files import scan_sources
from ..sources.store import GraphStore

#: Edge types that are resolved by name, and the types of their targets.
NAMED = {"implements_trait": ("trait",), "references": ("struct", "enum", "trait", "type_alias"), "expands_to": ("macro",)}


@dataclass
class IndexConfig:
    """git_coupling adds changes_with edges; trait_mapping has nothing to do without a compiler's index."""

    trait_mapping: bool = False
    git_coupling: bool = False
    fix_use_paths: bool = False


def build_graph(sources: DataFrame, config: IndexConfig | None = None, commits: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, dead functions) of ``file_id, content`` rows."""
    config = config or IndexConfig()
    facts = materialise(extract(sources))
    nodes, raw = raw_nodes(facts), raw_edges(facts)
    imports = materialise(resolve_imports(nodes, raw, use_paths(facts), config.fix_use_paths))
    known = raw.unionByName(imports)
    parts = [raw.where(~F.col("edge_type").isin("calls", *NAMED)), imports, resolve_calls(nodes, known)]
    parts += [resolve_names(nodes, known, kind, types) for kind, types in NAMED.items()]
    if commits is not None:
        parts.append(change_coupling(commits))
    edges = materialise(reduce(DataFrame.unionByName, parts).distinct())
    return nodes, edges, dead_functions(nodes, edges)


def index(spark: SparkSession, root: str, store: GraphStore, config: IndexConfig | None = None) -> None:
    """Index ``root`` and make the result the store's graph, all at once."""
    config = config or IndexConfig()
    commits = read_history(spark, root) if config.git_coupling else None
    store.replace(*build_graph(scan_sources(spark, root), config, commits))
