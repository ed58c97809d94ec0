"""Results as tab-separated text or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, null: str = "null") -> DataFrame:
    """One column ``value``: the cells of a row between tabs."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in df.columns]).alias("value"))


def finite(c: Column) -> Column:
    """Null for NaN and infinities, which JSON doesn't have."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def as_json(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a JSON object with its nulls."""
    cells = [finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))
