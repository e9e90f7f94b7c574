"""Ranked exploration of a query: candidates, bounded subgraph, random walk, files in order, symbols and blast radius."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import DEFINITION_KINDS, edge_order
from ..sources.shared import Written, written
from . import gather, scoring
from .expand import bounded_bfs, glue_nodes, ids_frame, rank_edges, type_hierarchy
from .lookup import MAX_FILES
from .rank import walk
from .seeding import named_seeds
from .traverse import blast_radius


@dataclass
class Exploration:
    """files (file_path, position, score, mass, hits, ...), symbols (file_path, position, id, name, kind, start_line,
    rank, callers, test_files) and skeletons; all empty when nothing fits."""

    query: str
    files: list[dict] = field(default_factory=list)
    symbols: DataFrame | None = None
    skeletons: list[str] = field(default_factory=list)


def explore(nodes: DataFrame, edges: DataFrame, query: str, max_files: int = 0, project: str = "") -> Exploration:
    if not query.strip():
        raise ValueError("the query must not be blank")
    if max_files < 0:
        raise ValueError("max_files must not be negative")
    spark = nodes.sparkSession
    terms = text.search_terms(query)
    candidates = written(gather.candidates(nodes, query))
    seeds = written(named_seeds(nodes, edges, query, project))
    seed_rows = seeds.collect()  # at most three definitions of each of sixteen names
    if not seed_rows and candidates.isEmpty():
        return Exploration(query)
    focal = candidates.filter(F.col("kind").isin(*DEFINITION_KINDS))
    hierarchy = type_hierarchy(nodes, edges, focal)
    reached, roots = bounded_bfs(nodes, edges, candidates)
    seed_ids = sorted({r["id"] for r in seed_rows})
    surfaced = sorted({*reached, *hierarchy, *seed_ids})
    glue = glue_nodes(nodes, edges, [*roots, *seed_ids], surfaced)
    final = sorted({*surfaced, *glue})
    if not final:
        return Exploration(query)
    sub = Written(nodes.join(F.broadcast(ids_frame(spark, final)), "id").drop("pos")).df  # under 400 nodes
    inside = rank_edges(edges)
    for end in ("source", "target"):
        inside = inside.join(F.broadcast(ids_frame(spark, final, end)).select(end), end, "left_semi")
    inside = written(inside.select("source", "target", "kind"))
    links = [(r["source"], r["target"]) for r in inside.orderBy(*edge_order("source", "kind", "target")).collect()]
    scores = walk(final, links, {*seed_ids, *roots})
    ranks = F.broadcast(spark.createDataFrame(list(scores.items()), "id string, score double"))  # under 400 nodes
    named = ids_frame(spark, sorted({r["id"] for r in seed_rows if r["is_primary"]}))
    entries = ids_frame(spark, roots)
    tiers = scoring.exclude_tests(scoring.file_tiers(sub, inside, named, entries), query)
    mass, hits = scoring.file_mass(sub, ranks), scoring.file_hits(sub, terms)
    if tiers.isEmpty():
        return Exploration(query)
    rescued = scoring.rescue(tiers, mass, hits, nodes, edges, named.select("id").union(entries.select("id")).distinct())
    counts = sub.filter("file_path <> ''").groupBy("file_path").agg(F.count(F.lit(1)).alias("n_nodes"))
    profiles = scoring.profile(rescued, mass, hits, counts).withColumns(
        {"low_value": paths.is_low_value(F.col("file_path")), "generated": paths.is_generated(F.col("file_path"))}
    )
    profiles = written(profiles)
    kept = [r.asDict() for r in scoring.gate(profiles).orderBy("file_path").collect()]  # files of the subgraph
    files = scoring.order_files(kept)
    if not max_files:
        indexed = nodes.filter("file_path <> ''").select(F.countDistinct("file_path")).first()[0]
        max_files = max(1, min(scoring.MOST_SHOWN, scoring.file_budget(indexed)))
    order = ids_frame(spark, [f["file_path"] for f in files], "file_path")
    shown = candidates.select("id").union(seeds.select("id")).distinct().join(nodes, "id")
    shown = shown.filter("file_path <> ''").join(F.broadcast(order), "file_path").join(ranks, "id", "left").withColumn("matched", F.lit(True))
    missing = order.join(shown.select("file_path").distinct(), "file_path", "left_anti")
    rest = sub.join(missing, "file_path").join(ranks, "id", "left").withColumn("matched", F.lit(False))
    columns = ["file_path", "pos", "id", "name", "kind", "start_line", "score", "matched"]
    every = shown.select(*columns).union(rest.select(*columns)).withColumn("score", F.coalesce("score", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "id"))
    every = written(every.withColumn("rank", rank).filter(F.col("matched") | (F.col("rank") == 1)))
    have = [r["pos"] for r in every.select("pos").distinct().orderBy("pos").limit(min(max_files, MAX_FILES)).collect()]
    every = every.filter(F.col("pos").isin(have))
    blast = blast_radius(every, nodes, edges)
    symbols = every.join(blast, "id").select(
        "file_path", F.col("pos").alias("position"), "id", "name", "kind", "start_line", "score", "rank", "callers", "test_files"
    )
    central = profiles.filter("central")
    skeletons = [r["file_path"] for r in scoring.skeleton_files(every, central, edges).orderBy("file_path").collect()]
    chosen = [dict(f, position=k) for k, f in enumerate(files) if k in set(have)]
    return Exploration(query, chosen, symbols.orderBy("position", "rank"), skeletons)
