"""Connected components by alternating large-star and small-star steps.

Each round keeps the components, and ends with every node linked to its smallest one
after about log(n) rounds. Only edges move; rounds are written to the shared folder, so
lineage stays short and nothing of the graph reaches the driver but one checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise, shared_dir
from .skew import attach

MAX_ROUNDS = 60


def _with_least(edges: DataFrame, total: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(``u, v, m``, ``u, m``): the smallest neighbour of each node; a hub's edges don't meet in one task. There are at most ``total`` edges."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), path)
    return attach(edges, least, "u", "n", total).drop("n"), least.select("u", "m")


def _round(edges: DataFrame, total: int, path: str) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near, _ = _with_least(both, 2 * total, f"{path}/least")
    large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
    large = materialise(large, f"{path}/large")
    near, small = _with_least(large, 2 * total, f"{path}/small")
    moved = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """``node, component`` for every node with an edge; component is its smallest node.

    Rows with a null end, self-loops and repeats are ignored. Nodes without an edge have
    no row.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u != v").distinct()
    folder = shared_dir(edges.sparkSession)
    now = materialise(now, f"{folder}/0")
    mark = _mark(now)
    for turn in range(MAX_ROUNDS):
        if not mark[0]:
            break
        steps = f"{folder}/{turn + 1}-steps"
        after = materialise(_round(now, mark[0], steps), f"{folder}/{turn + 1}")
        before, mark, now = mark, _mark(after), after
        for done in (f"{folder}/{turn}", steps):
            discard(edges.sparkSession, done)
        if mark == before:
            break
    else:
        raise RuntimeError("components: no fixpoint")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
