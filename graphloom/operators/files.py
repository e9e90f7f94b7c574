"""Browsing indexed files: filters, a directory tree, numbered source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .lookup import clamp_limit


def files(
    table: DataFrame, language: str = "", directory: str = "", pattern: str = "", max_depth: int = 0, limit: int | None = None
) -> DataFrame:
    """Rows of the files table by language, directory (on slash boundaries), glob on the whole path and depth."""
    if max_depth < 0:
        raise ValueError("depth must not be negative")
    if language:
        table = table.filter(F.col("language") == language)
    if directory:
        table = table.filter(paths.in_dir(F.col("path"), directory))
    if pattern:
        table = table.filter(F.col("path").rlike(paths.glob_regex(pattern)))
    if max_depth:
        table = table.filter(paths.depth(F.col("path")) < max_depth)
    return table.orderBy("path").limit(clamp_limit(limit))


def tree(listed: DataFrame) -> DataFrame:
    """parent, name, is_dir, n_files: the entries of each directory, directories first, then by name."""
    parts = listed.select("path", F.split("path", "/").alias("p"))
    steps = parts.select("path", F.size("p").alias("n"), F.posexplode("p").alias("k", "name"), "p")
    entries = steps.select(
        F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("parent"), "name", (F.col("k") < F.col("n") - 1).alias("is_dir")
    )
    grouped = entries.groupBy("parent", "name", "is_dir").agg(F.count(F.lit(1)).alias("n_files"))
    return grouped.orderBy("parent", F.desc("is_dir"), "name")


def nested(listed: DataFrame) -> dict:
    """The tree as nested dictionaries (at most a page of files reaches the driver)."""
    root: dict = {}
    for row in tree(listed).collect():
        at = root
        for part in filter(None, row["parent"].split("/")):
            at = at.setdefault(part, {})
        at[row["name"]] = at.get(row["name"], {}) if row["is_dir"] else None
    return root


def lines(sources: DataFrame) -> DataFrame:
    """path, line, text of every source; one trailing empty line is dropped."""
    text = F.col("content").cast("string")
    parts = F.split(text, "\n", -1)
    parts = F.when(F.endswith(text, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return sources.select("path", F.posexplode(parts).alias("k", "text")).select("path", (F.col("k") + 1).alias("line"), "text")


def numbered(sources: DataFrame, path: str, first: int = 1, last: int = 0) -> DataFrame:
    """line, text of a source file; a span is clamped into the file."""
    rows = lines(sources.filter(F.col("path") == path)).select("line", "text")
    if first > 1 or last:
        rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))  # one file
        low = F.least(F.lit(max(1, first)), F.col("_n"))
        rows = rows.filter((F.col("line") >= low) & (F.col("line") <= (F.least(F.lit(last), F.col("_n")) if last else F.col("_n"))))
    return rows.select("line", "text").orderBy("line")
