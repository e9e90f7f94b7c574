"""Random walk with restart over the explored subgraph: a bounded kernel and a distributed form."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round9
from ..sources.shared import Written
from .expand import both_ways

# Fixed values of the walk.
RESTART, ROUNDS, SCALE = 0.25, 25, 1e9


def walk(ids: list[str], links: list[tuple[str, str]], seeds: set[str]) -> dict[str, float]:
    """Scores of a bounded subgraph. ids sorted; links in scan order, parallel ones count; a lone node keeps its mass.

    Sums run in a fixed order, so scores repeat to the last bit before they are rounded to nine places.
    """
    at = {x: k for k, x in enumerate(ids)}
    near: list[list[int]] = [[] for _ in ids]
    for a, b in links:
        if a in at and b in at and a != b:
            near[at[a]].append(at[b])
            near[at[b]].append(at[a])
    base = [1.0 if x in seeds else 0.0 for x in ids]
    if not any(base):
        base = [1.0] * len(ids)
    total = sum(base)
    base = [x / total for x in base]
    mass = list(base)
    for _ in range(ROUNDS):
        moved = [0.0] * len(ids)
        for k, m in enumerate(mass):
            if not m:
                continue
            if not near[k]:
                moved[k] += m
                continue
            share = m / len(near[k])
            for j in near[k]:
                moved[j] += share
        mass = [(1 - RESTART) * x + RESTART * r for x, r in zip(moved, base, strict=True)]
    return {x: math.floor(m * SCALE + 0.5) / SCALE for x, m in zip(ids, mass, strict=True)}


def walk_distributed(ids: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, cut: int = 5) -> DataFrame:
    """id, score for a subgraph of any size: each round is a join and a sum; lineage is cut every ``cut`` rounds.

    Nodes get numbers, and links and nodes are dealt by number once: they are kept in that order, with a plan that makes
    them anew where an executor is lost. A round deals only what moves, and what has no mass yet does not.
    """
    tasks = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as sums by number are dealt
    named = Written(ids.select("id").distinct().withColumn("n", F.monotonically_increasing_id())).df
    end = lambda what, n: named.select(F.col("id").alias(what), F.col("n").alias(n))
    inside = edges.select("source", "target").filter("source <> target").join(end("source", "source_n"), "source").join(end("target", "target_n"), "target")
    inside = Written(inside.select(F.col("source_n").alias("source"), F.col("target_n").alias("target"))).df
    links = both_ways(inside).repartition(tasks, "a").persist(StorageLevel.MEMORY_AND_DISK)
    degree = links.groupBy(F.col("a").alias("n")).agg(F.count(F.lit(1)).alias("d"))
    chosen = named.join(seeds.select("id").distinct().withColumn("s", F.lit(1.0)), "id", "left")
    sums = chosen.agg(F.sum("s"), F.count(F.lit(1))).first()
    base = F.coalesce("s", F.lit(0.0)) / sums[0] if sums[0] else F.lit(1.0) / (sums[1] or 1)
    table = Written(chosen.join(degree, "n", "left").select("id", "n", base.alias("base"), "d")).df
    nodes = table.filter("d is not null").select("n", "base", "d").repartition(tasks, "n").persist(StorageLevel.MEMORY_AND_DISK)
    after = (1 - RESTART) * F.coalesce("moved", F.lit(0.0)) + RESTART * F.col("base")
    mass = nodes.withColumn("mass", F.col("base"))
    moved = None
    for k in range(rounds):
        share = mass.filter("mass <> 0").select("n", (F.col("mass") / F.col("d")).alias("share"))
        moved = links.join(share.hint("shuffle_hash"), F.col("a") == F.col("n")).groupBy("b").agg(F.sum("share").alias("moved"))
        if (k + 1) % cut == 0 or k + 1 == rounds:
            moved = Written(moved).df
        mass = nodes.join(moved.hint("shuffle_hash"), F.col("n") == F.col("b"), "left").select("n", "base", "d", after.alias("mass"))
    links.unpersist()
    nodes.unpersist()
    if moved is None:
        return table.select("id", round9(F.col("base")).alias("score"))
    met = table.join(moved, F.col("n") == F.col("b"), "left")  # a lone node keeps its mass
    return met.select("id", round9(F.when(F.col("d").isNull(), F.col("base")).otherwise(after)).alias("score"))
