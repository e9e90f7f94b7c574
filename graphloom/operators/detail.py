"""Several definitions of one symbol: which bodies to show within a budget, and their source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the display budget.
MOST_BODIES, MOST_BYTES, MOST_LISTED = 16, 12_000, 20


def body(content, start, end):
    """Lines start..end of a text, clamped into it."""
    lines = F.split(content, "\n", -1)
    low = F.least(F.greatest(start, F.lit(1)), F.size(lines))
    high = F.least(F.greatest(end, low), F.size(lines))
    return F.array_join(F.slice(lines, low, high - low + 1), "\n")


def bodies(defs: DataFrame, sources: DataFrame) -> DataFrame:
    """Definitions (pos, ...) with their source text and its size in bytes."""
    joined = defs.join(sources.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("content")), "file_path", "left")
    shown = joined.withColumn("body", body(F.coalesce("content", F.lit("")), F.col("start_line"), F.col("end_line")))
    return shown.withColumn("body_bytes", F.octet_length("body")).drop("content").orderBy("pos")


def within_budget(
    defs: DataFrame, by: str = "name", most: int = MOST_BODIES, most_bytes: int = MOST_BYTES, listed: int = MOST_LISTED
) -> DataFrame:
    """by, pos, shown, listed of each symbol: greedy in order; the first always fits, a later smaller one may still fit.

    A fold over the ordered sizes: the choice depends on all earlier ones, so it is no running sum.
    """
    item = F.struct("pos", "body_bytes")
    state = "struct<used:bigint,n:int,over:int,out:array<struct<pos:int,shown:boolean,listed:boolean>>>"
    zero = F.from_json(F.lit('{"used":0,"n":0,"over":0,"out":[]}'), state)

    def step(s, x):
        fits = (s["n"] == 0) | ((s["n"] < most) & (s["used"] + x["body_bytes"] <= most_bytes))
        one = F.struct(x["pos"].cast("int").alias("pos"), fits.alias("shown"), (~fits & (s["over"] < listed)).alias("listed"))
        return F.struct(
            (s["used"] + F.when(fits, x["body_bytes"]).otherwise(0)).cast("bigint").alias("used"),
            (s["n"] + fits.cast("int")).alias("n"),
            (s["over"] + (~fits).cast("int")).alias("over"),
            F.concat(s["out"], F.array(one)).alias("out"),
        )

    folded = defs.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("items"))  # two numbers a definition of a symbol
    return folded.select(by, F.explode(F.aggregate("items", zero, step)["out"]).alias("o")).select(by, "o.*")
