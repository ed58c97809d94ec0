"""Placeholders to nodes, as joins against grouped candidates.

A placeholder is ``file::name`` or ``file::path::name``. Candidates of a name are counted
in the file, among the caller's imports and globally; one expression then picks the
answer. Both resolvers start from raw edges and never see their own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import canonical_name, file_part
from ..sources.shared import materialise
from .skew import lookup


def _candidates(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], name: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    index = nodes.where(F.col("type").isin(*types) & (F.length("payload") > 0)).select("id", file_part(F.col("id")).alias("file"), name.alias("name"))
    local = index.groupBy("file", "name").agg(F.count("id").alias("n_local"), F.min("id").alias("local_id"))
    everywhere = index.groupBy("name").agg(F.count("id").alias("n_global"), F.min("id").alias("global_id"))
    imports = edges.where("edge_type = 'imports'").select(file_part(F.col("from_id")).alias("from_file"), F.col("to_id").alias("import"))
    is_item = F.col("import").contains("#")
    items = imports.where(is_item).join(index, F.col("import") == F.col("id")).select("from_file", "name", "import", "id")
    files = imports.where(~is_item).join(local.where("n_local = 1"), F.col("import") == F.col("file")).select("from_file", "name", "import", F.col("local_id").alias("id"))
    imported = items.unionByName(files).groupBy("from_file", "name").agg(F.count("id").alias("n_imported"), F.min_by("id", "import").alias("imported_id"))
    importers = imports.select("from_file").distinct().withColumn("imports", F.lit(True))
    return local, everywhere, imported, importers


def _joined(placeholders: DataFrame, local: DataFrame, everywhere: DataFrame, imported: DataFrame, importers: DataFrame) -> DataFrame:
    """``placeholders`` with what is known of their names; a name like ``new`` may be that of very many."""
    here, there = F.struct("file", "name").alias("here"), F.struct(F.col("from_file").alias("file"), "name")
    rows = materialise(placeholders.withColumn("here", here).withColumn("there", there))
    return lookup(rows, (local.select(here, "n_local", "local_id"), "here"), (everywhere, "name"), (imported.select(there.alias("there"), "n_imported", "imported_id"), "there"), (importers, "from_file"))


def resolve_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``calls`` edges with their targets resolved; those without one unambiguous target go.

    A path before the name binds within the caller's file only. Otherwise the file decides
    if it has the name at all; then the imports, if the file has any; then all functions.
    """
    calls = edges.where("edge_type = 'calls'").select("from_id", "to_id", file_part(F.col("from_id")).alias("from_file"))
    at = F.instr("to_id", "::")
    rest = F.when(at > 0, F.substring("to_id", at + 2, F.length("to_id"))).otherwise(F.col("to_id"))
    placeholders = calls.select(
        "from_id",
        "from_file",
        F.when(at > 0, F.substring_index("to_id", "::", 1)).otherwise(F.col("from_file")).alias("file"),
        F.substring_index(rest, "::", -1).alias("name"),
        (F.instr(rest, "::") > 0).alias("qualified"),
    )
    out = _joined(placeholders, *_candidates(nodes, edges, ("function",), canonical_name(F.col("payload"))))
    own = F.when(F.col("n_local") == 1, F.col("local_id"))
    by_import = F.when(F.col("n_imported") == 1, F.col("imported_id"))
    picked = F.when(F.col("qualified") | F.col("n_local").isNotNull(), own).when(F.col("imports"), by_import).when(F.col("n_global") == 1, F.col("global_id"))
    return out.select("from_id", picked.alias("to_id"), F.lit("calls").alias("edge_type")).where("to_id is not null").distinct()


def resolve_names(nodes: DataFrame, edges: DataFrame, edge_type: str, types: tuple[str, ...]) -> DataFrame:
    """Edges of one type resolved to nodes of ``types`` by their whole payload.

    Targets that are nodes already stay. The file decides if it has the name; else the first
    import that gives one node; else a globally unique node.
    """
    mine = edges.where(F.col("edge_type") == edge_type)
    open_ = F.instr("to_id", "::") > 0
    done = mine.where(F.col("to_id").contains("#") | ~open_)
    rest = F.substring("to_id", F.instr("to_id", "::") + 2, F.length("to_id"))
    placeholders = mine.where(~F.col("to_id").contains("#") & open_).select("from_id", file_part(F.col("from_id")).alias("from_file"), F.substring_index("to_id", "::", 1).alias("file"), rest.alias("name"))
    out = _joined(placeholders, *_candidates(nodes, edges, types, F.col("payload")))
    own = F.when(F.col("n_local") == 1, F.col("local_id"))
    picked = F.when(F.col("n_local").isNotNull(), own).otherwise(F.coalesce("imported_id", F.when(F.col("n_global") == 1, F.col("global_id"))))
    found = out.select("from_id", picked.alias("to_id"), F.lit(edge_type).alias("edge_type")).where("to_id is not null")
    return done.select("from_id", "to_id", "edge_type").unionByName(found).distinct()
