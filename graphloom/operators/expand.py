"""Growing the explored subgraph: type hierarchy, bounded breadth-first search, glue nodes.

The result is bounded by the budgets below, so admitted ids live in the driver; what they are chosen from (neighbours of
a hub, all types) stays distributed and is cut by take-ordered plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFINITION_KINDS, HIERARCHY_EDGES, RANK_EDGES
from ..sources.shared import Written
from .traverse import calls

# Fixed values of the exploration's bounds.
MAX_NODES, DEPTH, MIN_SCORE, SEARCH_LIMIT, GLUE_CAP = 200, 3, 0.2, 8, 60


def hierarchy_budget(max_nodes: int) -> int:
    return max(0, (max_nodes + 3) // 4)


def rank_edges(edges: DataFrame) -> DataFrame:
    """Edges that carry rank, without self loops."""
    return edges.filter(F.col("kind").isin(*RANK_EDGES) & (F.col("source") != F.col("target")))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for each edge in either direction; parallel edges stay."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return e.union(e.select("b", "a"))


def ids_frame(spark, ids: list[str], name: str = "id") -> DataFrame:
    """A small list of ids with their positions; it comes from the driver and is sent to where it is joined."""
    return F.broadcast(spark.createDataFrame([(x, k) for k, x in enumerate(ids)], f"{name} string, pos int"))


def closure(start: DataFrame, steps: DataFrame) -> DataFrame:
    """start (root), steps (a, b) -> (root, id, depth): everything reachable from each root, at its least depth."""
    front = Written(start.select("root", F.col("root").alias("id")).distinct())
    found: DataFrame | None = None
    depth = 0
    while True:  # until nothing new is reached
        depth += 1
        step = front.df.join(steps, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        step = step.filter("id <> root")
        if found is not None:
            step = step.join(found.select("root", "id"), ["root", "id"], "left_anti")
        front = Written(step)
        here = front.df.withColumn("depth", F.lit(depth))
        found = here if found is None else found.union(here)
        if front.df.isEmpty():
            return found
        if depth % 16 == 0:  # one table instead of a long union
            found = Written(found).df


def type_hierarchy(nodes: DataFrame, edges: DataFrame, focal: DataFrame, max_nodes: int = MAX_NODES) -> list[str]:
    """Ancestors, then descendants of each focal type in id order, then siblings under found parents; within budget."""
    budget = hierarchy_budget(max_nodes)
    if not budget:
        return []
    up = edges.filter(F.col("kind").isin(*HIERARCHY_EDGES)).select(F.col("source").alias("a"), F.col("target").alias("b"))
    types = nodes.filter(F.col("kind").isin(*DEFINITION_KINDS)).select("id")
    start = Written(focal.select("id").distinct().join(types, "id", "left_semi").withColumnRenamed("id", "root")).df
    parents = closure(start, up).withColumn("way", F.lit(0))
    children = closure(start, up.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("way", F.lit(1))
    outside = lambda df: df.join(start.withColumnRenamed("root", "id"), "id", "left_anti")
    order = F.min(F.struct("root", "way", "depth"))
    first = outside(parents.unionByName(children)).groupBy("id").agg(order.alias("o"))
    added = [r["id"] for r in first.orderBy("o", "id").limit(budget).collect()]
    if len(added) < budget:
        near = parents.select(F.col("id").alias("b")).distinct().join(up, "b").select(F.col("b").alias("parent"), F.col("a").alias("id"))
        have = ids_frame(nodes.sparkSession, added).select("id")
        more = outside(near).join(have, "id", "left_anti").groupBy("id").agg(F.min("parent").alias("parent"))
        added += [r["id"] for r in more.orderBy("parent", "id").limit(budget - len(added)).collect()]
    return sorted(added)


def bounded_bfs(
    nodes: DataFrame, edges: DataFrame, candidates: DataFrame, max_nodes: int = MAX_NODES, depth: int = DEPTH,
    min_score: float = MIN_SCORE, search_limit: int = SEARCH_LIMIT,
) -> tuple[list[str], list[str]]:
    """(node ids, root ids): the best candidates and what ranked edges reach from them, breadth first, capped.

    A level admits neighbours in the order of the frontier, then by id; edges to absent nodes are skipped.
    """
    spark = nodes.sparkSession
    best = candidates.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(search_limit)
    roots = sorted(r["id"] for r in best.select("id").collect())
    seen = roots[:max_nodes] if max_nodes else list(roots)
    if not roots:
        return [], []
    links = both_ways(rank_edges(edges))
    front = list(seen)
    for _ in range(depth):
        room = max_nodes - len(seen) if max_nodes else 1 << 30
        if not front or room <= 0:
            break
        met = ids_frame(spark, front, "a").join(links, "a").groupBy(F.col("b").alias("id")).agg(F.min("pos").alias("pos"))
        fresh = met.join(ids_frame(spark, seen).select("id"), "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
        front = [r["id"] for r in fresh.orderBy("pos", "id").limit(room).collect()]
        seen += front
    return sorted(seen), roots


def glue_nodes(nodes: DataFrame, edges: DataFrame, roots: list[str], surfaced: list[str], cap: int = GLUE_CAP) -> list[str]:
    """Direct callers and callees of the roots that live in files of ``surfaced`` nodes: the lowest ids."""
    if cap <= 0 or not roots:
        return []
    spark = nodes.sparkSession
    start = ids_frame(spark, sorted(set(roots)), "a").select("a")
    near = both_ways(calls(edges)).join(start, "a").select(F.col("b").alias("id")).distinct()
    near = near.join(start.withColumnRenamed("a", "id"), "id", "left_anti")
    shown = ids_frame(spark, surfaced).select("id").join(nodes, "id").filter("file_path <> ''").select("file_path").distinct()
    found = near.join(nodes.select("id", "file_path"), "id").join(shown, "file_path", "left_semi")
    return [r["id"] for r in found.select("id").orderBy("id").limit(cap).collect()]
