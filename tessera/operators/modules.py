"""Imports: use paths resolved to files and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import file_part, module_path


def file_modules(nodes: DataFrame) -> DataFrame:
    """``file_id, module`` of all files."""
    return nodes.where("type = 'file'").select(F.col("id").alias("file_id"), module_path(F.col("id")).alias("module"))


def module_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``module, file_id``: the one file that stands for each module path.

    The crate is its first file, or the first one named lib.rs. Another path belongs to
    its last file in id order; a file's top-level ``mod x`` whose file exists overrides.
    """
    files = file_modules(nodes)
    is_lib = F.col("file_id").contains("lib.rs")
    crate = files.where("module = 'crate'").agg(F.coalesce(F.min(F.when(is_lib, F.col("file_id"))), F.min("file_id")).alias("file_id")).where("file_id is not null").select(F.lit("crate").alias("module"), "file_id")
    others = files.where("module != 'crate'").groupBy("module").agg(F.max("file_id").alias("file_id"))
    mods = nodes.where("type = 'module' and payload is not null").select(F.col("id").alias("to_id"), "payload")
    inside = edges.where("edge_type = 'contains'").join(mods, "to_id").join(files, F.col("from_id") == files["file_id"])
    inside = inside.select("from_id", "to_id", F.concat("module", F.lit("::"), "payload").alias("module"))
    rel = F.replace(F.regexp_replace("module", "^crate::", ""), F.lit("::"), F.lit("/"))
    tried = inside.select("from_id", "to_id", "module", F.posexplode(F.array(F.concat(F.lit("./src/"), rel, F.lit(".rs")), F.concat(F.lit("./src/"), rel, F.lit("/mod.rs")))).alias("turn", "file_id"))
    named = tried.join(files.select("file_id"), "file_id").groupBy("from_id", "to_id", "module").agg(F.min_by("file_id", "turn").alias("file_id"))
    named = named.groupBy("module").agg(F.max_by("file_id", F.struct("from_id", "to_id")).alias("named"))
    return crate.unionByName(others).join(named, "module", "full").select("module", F.coalesce("named", "file_id").alias("file_id"))


def use_targets(uses: DataFrame, fix_use_paths: bool = False) -> DataFrame:
    """``use_path`` and ``module`` (of its file) to ``target`` module and ``item`` name (or null).

    Paths of three or more segments from ``crate`` or ``self`` keep that word in the module
    they look for and so never find one; ``fix_use_paths`` drops it.
    """
    out = uses.withColumn("s", F.filter(F.split(F.trim("use_path"), "::"), lambda x: x != ""))
    n, first, last = F.size("s"), F.get("s", F.lit(0)), F.element_at("s", -1)
    join = lambda a: F.concat_ws("::", a)
    middle = F.slice("s", 2, F.greatest(n - 2, F.lit(0)))
    led = middle if fix_use_paths else F.slice("s", 1, F.greatest(n - 1, F.lit(0)))
    parent = F.when(F.instr("module", "::") > 0, F.regexp_replace("module", "::[^:]*$", "")).otherwise(F.lit("crate"))
    base = F.when(first == "crate", F.lit("crate")).when(first == "self", F.col("module")).when(first == "super", parent)
    tail = F.when(n == 1, F.lit(None)).when(n == 2, F.get("s", F.lit(1))).when(first == "super", join(middle)).otherwise(join(led))
    target = F.when(tail.isNull(), base).otherwise(F.concat(base, F.lit("::"), tail))
    return out.where(n > 0).withColumn("target", target).withColumn("item", F.when(n > 2, last)).where("target is not null").drop("s")


def resolve_imports(nodes: DataFrame, edges: DataFrame, uses: DataFrame, fix_use_paths: bool = False) -> DataFrame:
    """``imports`` edges from each file to the item that a use path names, or else to its file."""
    wanted = use_targets(uses.join(file_modules(nodes), "file_id"), fix_use_paths)
    found = wanted.select(F.col("file_id").alias("from_id"), "target", "item").join(module_files(nodes, edges).withColumnRenamed("module", "target"), "target")
    items = nodes.where("type != 'file' and payload is not null").select(file_part(F.col("id")).alias("file_id"), F.regexp_replace("payload", "^pub::", "").alias("item"), "id")
    items = items.groupBy("file_id", "item").agg(F.min("id").alias("id"))
    return found.join(items, ["file_id", "item"], "left").select("from_id", F.coalesce("id", "file_id").alias("to_id"), F.lit("imports").alias("edge_type")).distinct()
