"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: str | None = None
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """URI of a new empty folder under ``spark.checkpoint.dir``.

    A temporary folder of this machine serves only where that setting is absent and
    Spark runs in one process, as in tests; a cluster must name a shared one.
    """
    global _FALLBACK
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if _FALLBACK is None:
            _FALLBACK = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _FALLBACK, ignore_errors=True)
        base = f"file://{_FALLBACK}"
    _MADE.append(f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}")
    return _MADE[-1]


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage and survives lost executors: every task can reread the files.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/table"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a table in files, else its materialised rows."""
    plain = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return df if plain else materialise(df)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`materialise` wrote, in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all tables and files that this process has put into the shared folder.

    Results that still read them must have been written elsewhere before.
    """
    while _MADE:
        discard(spark, _MADE.pop())
