"""Extraction: source files to raw nodes, edges and use paths, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.rust_parser import parse

RAW = "kind string, a string, b string, c string"


def extract(sources: DataFrame) -> DataFrame:
    """Facts of ``file_id, content`` rows.

    kind node: id, type, payload. kind edge: from, to (a placeholder ``file::name`` if not
    yet resolved), type. kind use: file, path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                facts = parse(file_id, content or "")
                rows = [("node", *n) for n in facts.nodes] + [("edge", *e) for e in dict.fromkeys(facts.edges)] + [("use", file_id, u, None) for u in facts.use_paths]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["kind", "a", "b", "c"])

    return sources.select("file_id", "content").mapInArrow(run, RAW)


def raw_nodes(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'node'").selectExpr("a id", "b type", "c payload").dropDuplicates(["id"])


def raw_edges(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'edge'").selectExpr("a from_id", "b to_id", "c edge_type").distinct()


def use_paths(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'use'").selectExpr("a file_id", "b use_path")
