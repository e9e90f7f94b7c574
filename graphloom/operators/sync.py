"""Incremental maintenance: what changed on disk, what goes, who depends on it.

Extraction runs for changed files only. References are looked up anew for changed files and for files that look up a name
which changed files declare or declared; all others keep their outcome. Synthesis runs over everything, since one method
can complete a type elsewhere. So syncing gives what a full run gives. Counters are counted again, not adjusted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_hash


def needs_full_run(meta: DataFrame | None) -> bool:
    """No index yet, or one without the file index."""
    row = meta.first() if meta is not None else None
    return row is None or not row["has_file_index"]


def changes(stored: DataFrame, disk: DataFrame) -> DataFrame:
    """path, state: added, modified, touched (same content, other stat), unchanged or deleted.

    Equal time and size mean unchanged without reading; only files whose stat differs are hashed.
    disk: path, mtime_unix_ns, size_bytes and content or content_hash.
    """
    have = stored.select("path", F.col("content_hash").alias("old_hash"), F.col("mtime_unix_ns").alias("old_mtime"), F.col("size_bytes").alias("old_size"))
    now = F.col("content_hash") if "content_hash" in disk.columns else content_hash(F.col("content"))
    stat = (F.col("mtime_unix_ns") == F.col("old_mtime")) & (F.col("size_bytes") == F.col("old_size"))
    both = disk.join(have, "path", "left").select(
        "path",
        F.when(F.col("old_hash").isNull(), "added").when(stat, "unchanged").when(now == F.col("old_hash"), "touched").otherwise("modified").alias("state"),
    )
    gone = have.join(disk.select("path"), "path", "left_anti").select("path", F.lit("deleted").alias("state"))
    return both.union(gone)


def prune_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes of files that stay. gone: (path)."""
    return nodes.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*nodes.columns)


def edge_owners(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the file that owns each: the file of its source."""
    where = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("owner"))
    return edges.join(where, "source", "left")


def prune_edges(edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges not owned by gone files: those that no node of such a file starts. Only ids of these nodes meet the edges."""
    lost = nodes.select("id", "file_path").join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return edges.join(lost.select(F.col("id").alias("source")), "source", "left_anti").select(*edges.columns)


def dependents(edges: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Files (path) with a call into a node of gone files, those themselves excluded."""
    lost = nodes.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("target"))
    into = edges.filter("kind = 'calls'").join(lost, "target", "left_semi")
    files = edge_owners(into, nodes).filter("owner is not null").select(F.col("owner").alias("path")).distinct()
    return files.join(gone.select("path"), "path", "left_anti")


def replace_rows(old: DataFrame, new: DataFrame, column: str, replaced: DataFrame) -> DataFrame:
    """old without the rows of replaced files (path), plus new."""
    kept = old.join(replaced.select(F.col("path").alias(column)), column, "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def stale_files(asked: DataFrame, declared: DataFrame, changed: DataFrame) -> DataFrame:
    """Files (file) whose references must be looked up anew: changed ones and those that ask for a declared name.

    asked: (file, module_key, name) of references; declared: (module_key, name) that changed files hold now or held before.
    """
    names = declared.select("module_key", "name").distinct()
    return asked.join(names, ["module_key", "name"], "left_semi").select("file").union(changed.select(F.col("path").alias("file"))).distinct()
