"""Benchmark medians and gates, coverage thresholds, smallest covering subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the gate.
MOST_THROUGHPUT_DROP, MOST_MEMORY_RISE, MEMORY_CEILING, MOST_SUBSETS = 0.10, 0.15, 4 << 30, 1024


def medians(trials: DataFrame, subject: str, value: str) -> DataFrame:
    return trials.groupBy(subject).agg(
        F.count(F.lit(1)).alias("days"), F.round(F.median(value), 6).alias("mid"), F.round(F.min(value), 6).alias("low")
    )


def gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """subject, ok, reason: throughput, memory and the absolute ceiling against a baseline of the same platform."""
    base = baseline.select("subject", *[F.col(c).alias(f"b_{c}") for c in ("goos", "goarch", "runner", "scratch_fs", "files_per_sec", "peak_rss_bytes")])
    joined = current.join(base, "subject", "left")
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in ("goos", "goarch", "runner", "scratch_fs")]
    reason = (
        F.when(F.col("b_files_per_sec").isNull(), "no baseline")
        .when(~(same[0] & same[1] & same[2] & same[3]), "another platform")
        .when(F.col("files_per_sec") < F.col("b_files_per_sec") * (1 - MOST_THROUGHPUT_DROP), "throughput")
        .when(F.col("peak_rss_bytes") > F.col("b_peak_rss_bytes") * (1 + MOST_MEMORY_RISE), "memory")
        .when(F.col("peak_rss_bytes") > MEMORY_CEILING, "memory ceiling")
        .otherwise("")
    )
    return joined.select("subject", (reason == "").alias("ok"), reason.alias("reason"))


def coverage(counts: DataFrame) -> DataFrame:
    """kind, best, repo (that supplies it), threshold = min(max(2, best div 2), best). counts: (repo, kind, n)."""
    best = counts.groupBy("kind").agg(F.max("n").alias("best"), F.min_by("repo", F.struct(-F.col("n"), F.col("repo"))).alias("repo"))
    return best.withColumn("threshold", F.least(F.greatest(F.lit(2), F.expr("best div 2")), F.col("best")).cast("long"))


def smallest_cover(counts: DataFrame, sizes: DataFrame, repos: list[str]) -> DataFrame:
    """The subset of at most ten repos that meets every threshold: fewest repos, then fewest files, then names."""
    if 1 << len(repos) > MOST_SUBSETS:
        raise ValueError("too many repositories for a subset search")
    spark = counts.sparkSession
    order = spark.createDataFrame([(r, k) for k, r in enumerate(sorted(repos))], "repo string, bit int")
    masks = spark.range(1, 1 << len(repos)).withColumnRenamed("id", "mask")
    inside = masks.join(order, F.expr("shiftright(mask, bit) & 1") == 1)
    kinds = coverage(counts).select("kind", "threshold")
    got = inside.join(counts, "repo").groupBy("mask", "kind").agg(F.max("n").alias("n"))
    met = got.join(kinds, "kind").filter("n >= threshold").groupBy("mask").agg(F.count(F.lit(1)).alias("met"))
    total = kinds.agg(F.count(F.lit(1)).alias("kinds"))
    full = met.crossJoin(F.broadcast(total)).filter("met = kinds").select("mask")
    described = inside.join(sizes, "repo").groupBy("mask").agg(
        F.count(F.lit(1)).alias("repos"), F.sum("tracked_files").alias("files"), F.sort_array(F.collect_list("repo")).alias("names")
    )
    return described.join(full, "mask").orderBy("repos", "files", "names").limit(1)


#: Keys whose values differ between runs.
VOLATILE = frozenset({"score", "lastIndexed", "dbSizeBytes", "projectPath", "indexPath", "worktreeMismatch", "stale"})


def without_volatile(value):
    """A JSON value without keys that differ between runs, at any depth."""
    if isinstance(value, dict):
        return {k: without_volatile(v) for k, v in value.items() if k not in VOLATILE and not k.endswith(("_at", "At"))}
    return [without_volatile(v) for v in value] if isinstance(value, list) else value
