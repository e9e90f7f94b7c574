"""File scores of an exploration: tiers, mass, term hits, exclusion, rescue, gate, order, budget."""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schema import RANK_EDGES, SIGNATURE_EDGES

# Fixed values of the file model.
NAMED, ENTRY, CONNECTED, OTHER, KEEP = 50.0, 10.0, 3.0, 1.0, 3.0
RESCUE_SHARE, RESCUE_HITS, RESCUE_FLOOR = 0.06, 2, 45.0
GATE_SHARE, GATE_HITS, GATE_FILES, CENTRAL, BAND = 0.06, 2, 2, 2, 0.01
BUDGETS, MOST_BUDGET, MOST_SHOWN = ((20, 3), (100, 5), (500, 8)), 12, 20
SKELETON_IMPLEMENTERS = 3


def connected_to(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes at the other end of a ranked edge of an entry node, entries themselves excluded."""
    ranked = edges.filter(F.col("kind").isin(*RANK_EDGES)).select("source", "target")
    e = entries.select(F.col("id").alias("e"))
    ahead = ranked.join(e, F.col("source") == F.col("e")).select(F.col("target").alias("id"))
    back = ranked.join(e, F.col("target") == F.col("e")).select(F.col("source").alias("id"))
    return ahead.union(back).distinct().join(entries.select("id"), "id", "left_anti")


def file_tiers(nodes: DataFrame, edges: DataFrame, named: DataFrame, entries: DataFrame) -> DataFrame:
    """file_path, score: best tier of the subgraph's nodes in a file; files under the threshold go."""
    tiers = named.select("id", F.lit(NAMED).alias("t")).union(entries.select("id", F.lit(ENTRY)))
    both = named.select("id").union(entries.select("id")).distinct()
    tiers = tiers.union(connected_to(edges, both).select("id", F.lit(CONNECTED)))
    best = tiers.groupBy("id").agg(F.max("t").alias("t"))
    scored = nodes.filter("file_path <> ''").join(best, "id", "left").withColumn("t", F.coalesce("t", F.lit(OTHER)))
    return scored.groupBy("file_path").agg(F.max("t").alias("score")).filter(F.col("score") >= KEEP)


def file_mass(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """file_path, mass: scores summed as decimals, so that the sum repeats to the last bit in any order.

    A partial aggregate. Scores of a walk have nine decimals, so each is added as it is.
    """
    met = nodes.filter("file_path <> ''").select("id", "file_path").join(scores, "id")
    return met.groupBy("file_path").agg(F.sum(F.col("score").cast("decimal(38,18)")).cast("double").alias("mass"))


def file_hits(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """file_path, hits: distinct terms in names of a file's nodes."""
    names = [F.lower("name"), F.lower("qualified_name")]
    each = [F.max(text.any_contains(names, t).cast("int")) for t in terms if t]
    total = sum(each[1:], each[0]) if each else F.lit(0)
    return nodes.filter("file_path <> ''").groupBy("file_path").agg(total.alias("hits"))


def exclude_tests(scores: DataFrame, query: str) -> DataFrame:
    """Drops low-value files, unless the query says test and two others remain: then all stay."""
    low = paths.is_low_value(F.col("file_path"))
    if "test" not in query.lower():
        return scores.filter(~low)
    others = scores.agg(F.count_if(~low).alias("others"))
    return scores.crossJoin(F.broadcast(others)).filter(~low | (F.col("others") >= 2)).drop("others")


def rescue(scores: DataFrame, mass: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """file_path, score, rescued: files that hold signature types of seeds but have little mass and few hits."""
    targets = edges.filter(F.col("kind").isin(*SIGNATURE_EDGES)).join(seeds.select(F.col("id").alias("source")), "source", "left_semi")
    files = targets.select(F.col("target").alias("id")).join(nodes, "id").filter("file_path <> ''").select("file_path").distinct()
    most = mass.agg(F.coalesce(F.max("mass"), F.lit(0.0)).alias("most"))
    buried = (
        files.join(mass, "file_path", "left")
        .join(hits, "file_path", "left")
        .crossJoin(F.broadcast(most))
        .filter((F.coalesce("mass", F.lit(0.0)) < F.col("most") * RESCUE_SHARE) & (F.coalesce("hits", F.lit(0)) < RESCUE_HITS))
        .select("file_path", F.lit(True).alias("rescued"))
    )
    joined = scores.join(buried, "file_path", "full_outer")
    lifted = F.when(F.col("rescued"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(RESCUE_FLOOR))).otherwise(F.col("score"))
    return joined.select("file_path", lifted.alias("score"), F.coalesce("rescued", F.lit(False)).alias("rescued"))


def profile(scores: DataFrame, mass: DataFrame, hits: DataFrame, counts: DataFrame) -> DataFrame:
    """All that gate and order look at, one row a file, with the central files marked."""
    joined = scores
    for other in (mass, hits, counts):
        joined = joined.join(other, "file_path", "left")
    joined = joined.na.fill({"mass": 0.0, "hits": 0, "n_nodes": 0})
    top = joined.filter("hits >= 1").orderBy(F.desc("mass"), "file_path").limit(CENTRAL).select("file_path", F.lit(True).alias("central"))
    return joined.join(top, "file_path", "left").withColumn("central", F.coalesce("central", F.lit(False)))


def gate(profiles: DataFrame) -> DataFrame:
    """Keeps files that meet one of five clauses; if fewer than two do, or nothing has mass, all stay."""
    whole = Window.partitionBy()  # files of a bounded subgraph
    p = profiles.withColumn("_most", F.max("mass").over(whole))
    passes = (
        (F.col("mass") >= F.col("_most") * GATE_SHARE)
        | F.col("central")
        | (F.col("score") >= ENTRY)
        | F.col("rescued")
        | (F.col("hits") >= GATE_HITS)
    )
    p = p.withColumn("_pass", passes).withColumn("_n", F.count_if("_pass").over(whole))
    return p.filter(F.col("_pass") | (F.col("_most") <= 0) | (F.col("_n") < GATE_FILES)).drop("_most", "_pass", "_n")


def order_files(rows: list) -> list:
    """Path-sorted profile rows in display order.

    Masses within one per cent of the largest count as equal, which is no strict order; a stable merge of insertion-
    sorted blocks of twenty gives the same outcome on every machine.
    """
    band = BAND * max((r["mass"] for r in rows), default=0.0)

    def before(a, b) -> bool:
        for x, y in (
            (a["score"] >= NAMED, b["score"] >= NAMED),
            (_corroborated(a), _corroborated(b)),
        ):
            if x != y:
                return x
        if abs(a["mass"] - b["mass"]) > band:
            return a["mass"] > b["mass"]
        left = (-a["hits"], a["low_value"], a["generated"], -a["score"], -a["n_nodes"], a["file_path"])
        return left < (-b["hits"], b["low_value"], b["generated"], -b["score"], -b["n_nodes"], b["file_path"])

    key = cmp_to_key(lambda a, b: -1 if before(a, b) else 1 if before(b, a) else 0)
    blocks = []
    for k in range(0, len(rows), 20):
        block: list = []
        for row in rows[k : k + 20]:
            at = len(block)
            while at and before(row, block[at - 1]):
                at -= 1
            block.insert(at, row)
        blocks.append(block)
    while len(blocks) > 1:
        merged = []
        for k in range(0, len(blocks), 2):
            merged.append(_merged(blocks[k], blocks[k + 1] if k + 1 < len(blocks) else [], key))
        blocks = merged
    return blocks[0] if blocks else []


def _merged(a: list, b: list, key) -> list:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if key(b[j]) < key(a[i]):
            out.append(b[j])
            j += 1
        else:
            out.append(a[i])
            i += 1
    return out + a[i:] + b[j:]


def _corroborated(r) -> bool:
    return (r["score"] >= ENTRY or r["central"]) and r["hits"] >= GATE_HITS


def file_budget(indexed_files: int) -> int:
    return next((n for most, n in BUDGETS if indexed_files <= most), MOST_BUDGET)


def skeleton_files(shown: DataFrame, central: DataFrame, edges: DataFrame) -> DataFrame:
    """Files off the spine with a shown symbol that implements an interface of three or more implementers."""
    implements = edges.filter("kind = 'implements'").select("source", "target")
    wide = implements.groupBy("target").agg(F.countDistinct("source").alias("n")).filter(F.col("n") >= SKELETON_IMPLEMENTERS)
    sources = implements.join(wide, "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return shown.join(sources, "id", "left_semi").select("file_path").distinct().join(central.select("file_path"), "file_path", "left_anti")
