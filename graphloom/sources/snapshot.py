"""Versioned snapshots of a graph: immutable Parquet tables, one pointer that names the current version.

A write goes to a new version; its number is created last, as an empty file in ``commits``, and readers take the largest
number there: they see the old or the new graph whole, whenever a writer stops. Creating fails where another writer has
committed that version. Edges are partitioned by kind. Everything goes through Hadoop file systems, so the store may be any that Spark reads.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

TABLES = {
    "nodes": schema.NODES, "edges": schema.EDGES, "files": schema.FILES, "meta": schema.META, "refs": schema.REFS,
    "imports": schema.IMPORTS, "iface_methods": schema.IFACE_METHODS, "method_arity": schema.METHOD_ARITY, "sources": schema.SOURCES,
}
GRAPH = ("nodes", "edges", "files", "meta")


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, tail: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tail}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """Number of the current version; 0 if there is none."""
        path, fs = self._path("commits")
        if not fs.exists(path):
            return 0
        return max((int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()), default=0)

    def commit(self, version: int) -> None:
        """Points readers to a version."""
        target, fs = self._path(f"commits/{version}")
        fs.create(target, False).close()

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Writes the tables as the next version and commits it. Extra columns (module_key of files) are kept."""
        version = self.current() + 1
        for name, df in tables.items():
            writer = df.write.mode("overwrite").option("compression", "zstd")
            if name == "edges":
                writer = writer.partitionBy("kind")
            writer.parquet(f"{self.root}/v={version}/{name}")
        self.commit(version)
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of one version (the current one, pinned when this is called)."""
        version = self.current() if version is None else version
        if not version:
            return schema.empty(self.spark, TABLES[name])
        df = self.spark.read.parquet(f"{self.root}/v={version}/{name}")
        return df.select(*TABLES[name].names, *[c for c in df.columns if c not in TABLES[name].names])

    def has(self, name: str, version: int) -> bool:
        path, fs = self._path(f"v={version}/{name}")
        return fs.exists(path)

    def size_bytes(self) -> int:
        path, fs = self._path("")
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def meta_row(spark: SparkSession, nodes: DataFrame, edges: DataFrame, synced_ms: int | None = None) -> DataFrame:
    """The singleton meta table, counted from the tables it describes."""
    counted = nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count")))
    now = int(time.time() * 1000) if synced_ms is None else synced_ms
    return schema.conform(
        counted.withColumns(
            {"schema_version": F.lit(schema.SCHEMA_VERSION), "last_sync_unix_ms": F.lit(now), "healthy": F.lit(True), "has_file_index": F.lit(True)}
        ),
        schema.META,
    )


# ---- exchange ------------------------------------------------------------------------------------------------------

MOST_RECORD = 64 << 20
_ORDER = {"meta": 0, "nodes": 1, "edges": 2, "files": 3}
_KEYS = {"nodes": ("id",), "edges": ("source", "kind", "target"), "files": ("path",), "meta": ("schema_version",)}


def export(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON record a row (table, key, body), sorted by table and scan order, so equal graphs give equal records."""
    every = None
    for name in _ORDER:
        df = tables[name]
        key = F.concat_ws("\u0001", *[x for c in _KEYS[name] for x in (F.lpad(F.octet_length(c).cast("string"), 9, "0"), F.col(c).cast("string"))])
        rows = df.select(F.lit(_ORDER[name]).alias("part"), F.lit(name).alias("table"), key.alias("key"), F.to_json(F.struct(*TABLES[name].names)).alias("body"))
        every = rows if every is None else every.union(rows)
    ordered = every.repartitionByRange("part", "key").sortWithinPartitions("part", "key")
    ordered.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of an export; a record over 64 MiB is an error."""
    rows = spark.read.schema("part int, table string, key string, body string").json(path)
    rows = rows.withColumn("body", F.when(F.octet_length("body") > MOST_RECORD, F.raise_error(F.lit("a record is too large"))).otherwise(F.col("body")))
    return {
        name: rows.filter(F.col("table") == name).select(F.from_json("body", TABLES[name]).alias("r")).select("r.*") for name in _ORDER
    }
