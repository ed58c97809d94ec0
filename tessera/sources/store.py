"""The graph store: three tables, in memory or as Parquet snapshots behind one pointer.

A snapshot is written whole to a new folder; renaming the pointer file then makes it
current, so readers see the old graph or the new one and never a part.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vocab import DEAD, EDGE_TYPES, EDGES, NODE_TYPES, NODES, check

TABLES = {"nodes": NODES, "edges": EDGES, "dead_functions": DEAD}


class GraphStore:
    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        """Open ``path``, creating it if need be; without a path the store is in memory."""
        self.spark, self.path = spark, path
        self.tables: dict[str, DataFrame] = {}
        if path is not None:
            self._fs().mkdirs(self._p(""))
        self._load()

    # Files, through Hadoop's file systems

    def _p(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}" if name else self.path)

    def _fs(self):
        return self._p("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        if self.path is None or not self._fs().exists(self._p("CURRENT")):
            return None
        return self.spark.read.text(f"{self.path.rstrip('/')}/CURRENT").first()[0]

    def _load(self) -> None:
        current = self._current()
        for name, schema in TABLES.items():
            if current is None:
                self.tables[name] = self.spark.createDataFrame([], schema)
            else:
                self.tables[name] = self.spark.read.schema(schema).parquet(f"{self.path.rstrip('/')}/{current}/{name}")

    def refresh(self) -> None:
        """See what other writers have made current."""
        if self.path is not None:
            self._load()

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def indexed_at(self) -> int | None:
        """Seconds since 1970 of the current snapshot."""
        if self.path is None or not self._fs().exists(self._p("CURRENT")):
            return None
        return self._fs().getFileStatus(self._p("CURRENT")).getModificationTime() // 1000

    # Tables

    @property
    def nodes(self) -> DataFrame:
        return self.tables["nodes"]

    @property
    def edges(self) -> DataFrame:
        return self.tables["edges"]

    @property
    def dead_functions(self) -> DataFrame:
        return self.tables["dead_functions"]

    def replace(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, dead: DataFrame | None = None) -> None:
        """Make these the tables; those not given stay. Edges are a set, nodes have one row per id."""
        new = dict(self.tables)
        if nodes is not None:
            new["nodes"] = nodes.select("id", "type", "payload").dropDuplicates(["id"])
        if edges is not None:
            new["edges"] = edges.select("from_id", "to_id", "edge_type").distinct()
        if dead is not None:
            new["dead_functions"] = dead.select("id").distinct()
        if self.path is None:
            self.tables = new
            return
        name, old = f"snapshot-{time.time_ns()}-{uuid.uuid4().hex[:8]}", self._current()
        base = f"{self.path.rstrip('/')}/{name}"
        for table, df in new.items():
            out = df.repartition("edge_type").sortWithinPartitions("from_id") if table == "edges" else df
            out.write.parquet(f"{base}/{table}")
        self._point(name)
        self._load()
        if old:
            self._fs().delete(self._p(old), True)

    def _point(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        fresh = self._p(f"CURRENT-{uuid.uuid4().hex}")
        out = self._fs().create(fresh, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._p("").toUri() if "://" in self.path else self._fs().getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(fresh), context.makeQualified(self._p("CURRENT")), overwrite)

    # Single changes

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def put_nodes(self, rows: list[tuple[str, str, str | None]]) -> None:
        """Insert or replace by id; of several rows for an id the last counts."""
        for r in rows:
            check(r[1], NODE_TYPES)
        if not rows:
            return
        fresh = self._rows([(*r, k + 1) for k, r in enumerate(rows)], f"{NODES}, turn int")
        both = self.nodes.withColumn("turn", F.lit(0)).unionByName(fresh)
        latest = Window.partitionBy("id").orderBy(F.desc("turn"))
        self.replace(nodes=both.withColumn("place", F.row_number().over(latest)).where("place = 1"))

    def put_edges(self, rows: list[tuple[str, str, str]]) -> None:
        for r in rows:
            check(r[2], EDGE_TYPES)
        if rows:
            self.replace(edges=self.edges.unionByName(self._rows(rows, EDGES)))

    def put_node(self, node_id: str, node_type: str, payload: str | None = None) -> None:
        self.put_nodes([(node_id, node_type, payload)])

    def put_edge(self, from_id: str, to_id: str, edge_type: str) -> None:
        self.put_edges([(from_id, to_id, edge_type)])

    def remove_edge(self, from_id: str, to_id: str, edge_type: str) -> None:
        """Remove one edge; nothing happens if it isn't there."""
        gone = self._rows([(from_id, to_id, edge_type)], EDGES)
        self.replace(edges=self.edges.join(gone, ["from_id", "to_id", "edge_type"], "left_anti"))

    def put_dead(self, ids: list[str]) -> None:
        if ids:
            self.replace(dead=self.dead_functions.unionByName(self._rows([(i,) for i in ids], DEAD)))

    def clear_dead(self) -> None:
        self.replace(dead=self.spark.createDataFrame([], DEAD))

    def clear(self) -> None:
        self.replace(*(self.spark.createDataFrame([], s) for s in TABLES.values()))

    def copy_from(self, other: GraphStore) -> None:
        """Add the other store's graph; rows of types outside the vocabulary are left out."""
        nodes = other.nodes.where(F.col("type").isin(*NODE_TYPES))
        edges = other.edges.where(F.col("edge_type").isin(*EDGE_TYPES))
        kept = self.nodes.join(nodes, "id", "left_anti")
        self.replace(kept.unionByName(nodes), self.edges.unionByName(edges), self.dead_functions.unionByName(other.dead_functions))

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()
