"""Reachability by a semi-naive loop: each round expands only what the last one found.

Rounds are appended to one table in the shared folder, which cuts lineage and survives
lost executors; the driver sees a row count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise, shared_dir, written


def reach(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id`` of the seeds and all that lies within ``rounds`` steps (any number if None).

    seeds: ``id``. edges: ``from_id, to_id``. Cycles end by themselves, as an id is
    expanded once.
    """
    spark, folder = seeds.sparkSession, shared_dir(seeds.sparkSession)
    schema = "id string"
    steps = edges.select("from_id", "to_id")
    if rounds is None or rounds > 1:
        # Each round joins the edges: what they are made of is read once.
        steps = written(steps)
    frontier = materialise(seeds.select("id").where("id is not null").distinct(), f"{folder}/round=0")
    turn = 0
    while (rounds is None or turn < rounds) and not frontier.isEmpty():
        turn += 1
        known = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
        ahead = frontier.join(steps, F.col("id") == F.col("from_id")).select(F.col("to_id").alias("id")).distinct()
        frontier = materialise(ahead.join(known, "id", "left_anti"), f"{folder}/round={turn}")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
