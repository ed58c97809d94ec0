"""Re-indexing on change, as a streaming query.

A file source doesn't report changed or deleted files, so a clock stream triggers a look
at the listing (names, sizes, times). All changes since the last look make one batch, which
indexes everything and then swaps the store's snapshot; if that fails, the old graph stays.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.indexing import IndexConfig, index
from ..sources.source_files import list_sources
from ..sources.store import GraphStore

INTERVAL = "2 seconds"


def fingerprint(root: str) -> dict[str, tuple[int, int]]:
    """Size and time of each source; paths that contain ``target`` don't count."""
    out = {}
    for path in list_sources(root):
        full = os.path.join(root, path)
        if "target" not in full:
            try:
                s = os.stat(full)
            except OSError:
                continue
            out[path] = (s.st_size, s.st_mtime_ns)
    return out


def watch(spark: SparkSession, root: str, store: GraphStore, config: IndexConfig | None = None, interval: str = INTERVAL, say=print) -> StreamingQuery:
    """Start watching ``root``; ``stop()`` of the result ends it."""
    seen = {"now": fingerprint(root)}

    def look(batch: DataFrame, batch_id: int) -> None:
        now = fingerprint(root)
        if now == seen["now"]:
            return
        seen["now"] = now
        try:
            index(spark, root, store, config)
            say(f"Re-indexed {root}")
        except Exception as e:
            say(f"Re-index failed: {e}")

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(look).trigger(processingTime=interval).start()
