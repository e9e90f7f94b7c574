"""Connected components of an edge table by alternating large-star and small-star contraction (a published method).

Every step is an aggregation and an equi-join on node ids whose hot keys adaptive execution splits; the driver
sees whether it is settled. Tasks first contract their own edges to spanning forests, which only removes redundant edges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

SCHEMA = "u long, v long"


#: Edges that a task contracts together.
CHUNK = 1 << 20


def _forest(batches):
    """Union-find over up to CHUNK edges of a task: (u, v) -> (node, smallest node it reaches among them)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush():
        pairs = [(x, find(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

    seen = 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield flush()
            seen = 0
    yield flush()


def _settled(edges: DataFrame) -> bool:
    """Is every node under one root, and no root under another?"""
    parents = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    roots = parents.select(F.col("v").alias("r")).distinct()
    wrong = parents.join(roots, F.col("u") == F.col("r"), "left").filter("n > 1 OR r IS NOT NULL")
    return wrong.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, root): every node of an edge but the roots, with the smallest node of its component."""
    now = Written(edges.select("u", "v").filter("u <> v").mapInArrow(_forest, SCHEMA))
    while not _settled(now.df):
        both = now.df.union(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Written(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now.drop()
        now = after
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
