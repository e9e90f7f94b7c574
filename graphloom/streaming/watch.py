"""Watching a tree: change events, debounce as session windows, one serialised sync a flush."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the watcher.
QUIET = "2 seconds"
MOST_REQUEUES = 5
RETRY_SECONDS = 0.1
#: Spans of a gap's length that are looked at together for where a burst of a table starts.
BLOCK = 1024


def quiet_gap(env: Mapping[str, str] = os.environ) -> str:
    """The debounce gap: two seconds, or the milliseconds that the environment asks for."""
    asked = env.get("GRAPHLOOM_DEBOUNCE_MS", "")
    return f"{int(asked)} milliseconds" if asked.isdigit() and int(asked) > 0 else QUIET


def why_not_watch(root: str, no_watch: bool = False, force: bool = False, env: Mapping[str, str] = os.environ, wsl: bool = False) -> str:
    """Reason for not watching a tree, or an empty text. Switching off wins over forcing, forcing over the mount rule."""
    if no_watch or env.get("GRAPHLOOM_NO_WATCH") == "1":
        return "watching is switched off"
    if force or env.get("GRAPHLOOM_FORCE_WATCH") == "1":
        return ""
    if wsl and re.match(r"(?i)^/mnt/[a-z](/|$)", root.replace("\\", "/")):
        return "the tree is on a drive mount on which watching is unreliable"
    return ""


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of change events (path, ts) from a folder of JSON lines that a notifier appends to."""
    return spark.readStream.schema("path string, ts timestamp").json(folder)


def debounce(changes: DataFrame, quiet: str = QUIET, keys: list[str] | None = None, late: str | None = None) -> DataFrame:
    """Bursts: each event restarts the quiet gap; a burst gives the set of its paths. Batch or streaming.

    In a stream a burst is emitted once the watermark has passed its end; a later event opens a new burst.
    """
    if not changes.isStreaming:
        return _bursts(changes, quiet, keys or [])
    changes = changes.withWatermark("ts", late or quiet)
    if not keys:  # a stream needs a key beside the window: an empty text that is no literal
        changes = changes.withColumn("_tree", F.substring("path", 1, 0))
    window = F.session_window("ts", quiet).alias("burst")
    grouped = changes.groupBy(*(keys or ["_tree"]), window).agg(
        F.sort_array(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n_events")
    )
    return grouped.select(*(keys or []), F.col("burst.start").alias("started"), F.col("burst.end").alias("ended"), "paths", "n_events")


def _bursts(changes: DataFrame, quiet: str, keys: list[str]) -> DataFrame:
    """The session windows of a table, without a task that takes all events of a key.

    Events are counted by spans as long as the gap: those of one span are of one burst, and only the span before can hold
    an event that is near enough. Where a burst starts is carried along ``BLOCK`` spans at a time, then along the blocks.
    """
    gap = changes.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL '{quiet}') AS g").first()["g"]
    at = changes.filter("ts IS NOT NULL").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    at = at.withColumn("_span", F.expr(f"(_us - pmod(_us, {gap}L)) div {gap}L"))
    counted = at.groupBy(*keys, "_span", "path").agg(F.count(F.lit(1)).alias("n"), F.min("_us").alias("low"), F.max("_us").alias("high"))
    spans = counted.groupBy(*keys, "_span").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    none = F.lit(None).cast("long")
    ahead = spans.select(*keys, (F.col("_span") + 1).alias("_span"), none.alias("low"), F.col("high").alias("before"))
    met = spans.select(*keys, "_span", "low", none.alias("before")).union(ahead).groupBy(*keys, "_span").agg(F.max("low").alias("low"), F.max("before").alias("before"))
    met = met.filter("low IS NOT NULL")
    fresh = met.withColumn("_start", F.when(F.col("before").isNull() | (F.col("low") - F.col("before") > gap), F.col("_span")))
    fresh = fresh.select(*keys, "_span", "_start", F.expr(f"(_span - pmod(_span, {BLOCK}L)) div {BLOCK}L").alias("_block"))
    blocks = fresh.groupBy(*keys, "_block").agg(F.max("_start").alias("_last"))
    earlier = F.max("_last").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", earlier.alias("_carried"))
    so_far = F.max("_start").over(Window.partitionBy(*keys, "_block").orderBy("_span"))
    fresh = fresh.withColumn("_so_far", so_far).alias("f").join(blocks.alias("b"), _same("f", "b", [*keys, "_block"]))
    fresh = fresh.select(*(F.col(f"f.{k}").alias(k) for k in keys), "_span", F.coalesce("_so_far", "_carried").alias("_burst"))
    placed = counted.alias("c").join(fresh.alias("f"), _same("c", "f", [*keys, "_span"]))
    placed = placed.groupBy(*(F.col(f"c.{k}").alias(k) for k in keys), "_burst", "path").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    grouped = placed.groupBy(*keys, "_burst").agg(
        F.timestamp_micros(F.min("low")).alias("started"), F.timestamp_micros(F.max("high") + gap).alias("ended"),
        F.sort_array(F.collect_list("path")).alias("paths"), F.sum("n").alias("n_events"),
    )
    return grouped.select(*keys, "started", "ended", "paths", "n_events")


def _same(left: str, right: str, columns: list[str]):
    return reduce(lambda x, y: x & y, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def flush_to(bursts: DataFrame, sync: Callable[[set[str]], None], checkpoint: str, locked: type[Exception] = BlockingIOError):
    """Starts the query: one sync at a time over the union of a micro-batch's paths; a locked store is tried again.

    A batch that fails stays uncommitted, so its paths are pending until a later run succeeds.
    """

    def run(batch: DataFrame, _: int) -> None:
        rows = batch.select(F.explode("paths").alias("path")).distinct().collect()  # changed files of one flush
        names = {r["path"] for r in rows}
        for k in range(MOST_REQUEUES + 1 if names else 0):
            try:
                return sync(names)
            except locked:
                if k == MOST_REQUEUES:
                    raise
                time.sleep(RETRY_SECONDS)

    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run).start()
