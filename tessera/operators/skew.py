"""Joins against one row per group where a single group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise

#: Groups with more than 1/HOT_GROUPS of all rows; there can't be more than HOT_GROUPS of these.
HOT_GROUPS = 5000


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, merge: bool = False) -> DataFrame:
    """Left join ``rows`` with ``groups`` (unique in ``key``) without a hot task.

    ``groups[size]`` bounds how many rows have the key and ``total`` is the number of
    rows. Groups over ``total / HOT_GROUPS`` number fewer than HOT_GROUPS, a bound that
    holds at any scale, so these are broadcast; for the others a shuffled join gets at
    most ``total / HOT_GROUPS`` rows for a key. ``groups`` should be a written table, as
    it is read twice. Null keys match nothing and stay. ``merge``: groups grow with the
    input, so they are joined by shuffle at any size, and small inputs show the plan of
    large ones.
    """
    limit = max(total // HOT_GROUPS, 1)
    cols = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).select(F.col(key), *[F.col(c).alias(f"__hot_{c}") for c in cols], F.lit(True).alias("__hot"))
    rest = groups.where(F.col(size) <= limit)
    tagged = rows.join(F.broadcast(hot), key, "left")
    # A row of a hot group takes a key of its own in the shuffled join: it finds nothing and isn't dealt to one task.
    cold = tagged.withColumn("__cold", F.when(F.col("__hot").isNull(), F.col(key)))
    spread = F.when(F.col("__cold").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0))
    cold = cold.withColumn("__spread", spread)
    rest = rest.withColumnRenamed(key, "__key").withColumn("__zero", F.lit(0).cast("long"))
    rest = rest.hint("merge") if merge else rest
    out = cold.join(rest, (F.col("__cold") == F.col("__key")) & (F.col("__spread") == F.col("__zero")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"__hot_{c}"), F.col(c)).alias(c) for c in cols])


def lookup(rows: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """Left join ``rows`` (a written table) with each (groups, key), unique in ``key``, however many rows have one key."""
    total, out = rows.count(), rows
    for groups, key in tables:
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
        known = materialise(groups.join(sizes, key))
        out = attach(out, known, key, "__rows", total).drop("__rows")
    return out
