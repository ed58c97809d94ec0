"""Exact dedup: skew-safe combining in three steps, each comparing full content.

1. Local: Spark's map-side combine keeps one row per (digest, salt, content) in a task.
2. Salted: the local winners of a digest meet in at most SALTS tasks.
3. Global: at most SALTS winners per content are combined.

Every grouping has the content beside its digest, so equal digests of different texts
never merge. The rows then look their group up by digest; digests shared by different
contents (checked, practically never) are looked up by content as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .skew import attach

SALTS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty, and A-Z lower-cased; no other letter changes."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """One row per digest: ``digest, variants, keep_id, group_size``.

    ``variants`` counts the different contents of the digest; with one, ``keep_id`` and
    ``group_size`` are those of the content.
    """
    digest = digest or (lambda c: F.sha2(c, 256))
    content = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("__id"), content.alias("__content"), digest(content).alias("__digest"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("__salt"))
    salted = rows.groupBy("__digest", "__salt", "__content").agg(F.max("__id").alias("__id"), F.count(F.lit(1)).alias("__n"))
    merged = salted.repartition("__digest").groupBy("__digest", "__content").agg(F.max("__id").alias("__id"), F.sum("__n").alias("__n"))
    # Still dealt by digest, so counting the variants of one takes no further shuffle.
    each = merged.groupBy("__digest").agg(F.count(F.lit(1)).alias("variants"), F.max("__id").alias("keep_id"), F.sum("__n").alias("group_size"))
    return each.withColumnRenamed("__digest", "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """All rows and columns of ``docs`` plus ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of
    equal texts the row with the largest id stays. Rows that repeat an id with the same
    text share its verdict; a null id is never the largest. With null ids only, keep_id is null
    and all these rows stay, as nothing tells them apart. Texts of any length are compared
    whole. An empty table gives an empty result. Columns of the input that have the name of
    a result column give way to it; other names are free, but for those that begin with two
    underscores.
    """
    digest = digest or (lambda c: F.sha2(c, 256))
    results = ["keep_id", "group_size", "kept", "text_sha256"]
    keep = [c for c in docs.columns if c not in results]
    groups = materialise(content_groups(docs, id_col, text_col, digest).where((F.col("group_size") > 1) | (F.col("variants") > 1)))
    content = normalised(F.col(text_col))
    # The digests are taken before the join, so a caller who drops the text shuffles none of it.
    rows = docs.select(*keep, digest(content).alias("__digest"), F.sha2(content, 256).alias("__sha256"))
    groups = groups.toDF("__digest", "__variants", "__keep", "__size")
    found = attach(rows, groups, "__digest", "__size", docs.count(), merge=True)
    if groups.where("__variants > 1").limit(1).count():
        found = _by_content(found, id_col, text_col)
    keep_id = F.when(F.col("__size").isNull(), F.col(id_col)).otherwise(F.col("__keep"))
    size = F.coalesce("__size", F.lit(1)).cast("long")
    return found.select(*keep, keep_id.alias("keep_id"), size.alias("group_size"), F.col(id_col).eqNullSafe(keep_id).alias("kept"), F.col("__sha256").alias("text_sha256"))


def _by_content(found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For digests with several contents, group by the content itself."""
    clear = found.where(F.coalesce(F.col("__variants"), F.lit(1)) == 1)
    mixed = found.where(F.col("__variants") > 1).drop("__keep", "__size").withColumn("__content", normalised(F.col(text_col)))
    groups = mixed.groupBy("__digest", "__content").agg(F.max(id_col).alias("__keep"), F.count(F.lit(1)).alias("__size"))
    return clear.unionByName(mixed.join(groups, ["__digest", "__content"]).select(*clear.columns))
