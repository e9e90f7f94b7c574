"""Counts, breakdowns and staleness of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RANK_EDGES


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def nodes_by_kind(nodes: DataFrame) -> DataFrame:
    return counts(nodes, "kind")


def edges_by_kind(edges: DataFrame) -> DataFrame:
    return counts(edges, "kind")


def files_by_language(files: DataFrame) -> DataFrame:
    return counts(files.filter("language <> ''"), "language")


def dense_edge_kinds(sparse: DataFrame) -> DataFrame:
    """Zero rows for ranked kinds that do not occur; other kinds stay."""
    kinds = sparse.sparkSession.createDataFrame([(k,) for k in RANK_EDGES], "key string")
    return kinds.join(sparse, "key", "full_outer").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def ordered(rows: DataFrame, drop_zero: bool = True) -> DataFrame:
    """Largest first, then by key."""
    return (rows.filter("n > 0") if drop_zero else rows).orderBy(F.desc("n"), "key")


def status(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """section, key, n: the whole breakdown in one table of counts (three independent aggregations)."""
    part = lambda rows, name: rows.select(F.lit(name).alias("section"), "key", "n")
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("key"), "n")
    return (
        part(nodes_by_kind(nodes), "nodes_by_kind")
        .union(part(dense_edge_kinds(edges_by_kind(edges)), "edges_by_kind"))
        .union(part(files_by_language(files), "files_by_language"))
        .union(total(nodes, "nodes"))
        .union(total(edges, "edges"))
        .union(total(files, "files"))
    )


def staleness(on_disk: DataFrame, meta: DataFrame, pending: bool = False) -> DataFrame:
    """One row: newest_ms, last_sync_unix_ms, stale."""
    newest = on_disk.agg(F.coalesce(F.max(F.expr("mtime_unix_ns div 1000000")), F.lit(0)).alias("newest_ms"))
    both = newest.crossJoin(meta.select("last_sync_unix_ms"))  # one row each
    return both.withColumn("stale", F.lit(pending) | (F.col("newest_ms") > F.col("last_sync_unix_ms")))
