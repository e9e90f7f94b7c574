"""Operator 2: mixing sources to target weights.

Words are summed per source (map-side partial sums), targets are shares of the whole by weight, capped at a multiple of
the source's own size, and the excess is reshared until no source is above its cap. A source's repetition rate is
target / size; a document is emitted floor(rate) times plus once more with probability equal to the fraction, drawn
from a hash of the seed and doc_id, so reruns and recomputed tasks agree.

Defined cases: null or blank text has size 0 and is taken 0 words; a null source is a source of its own, ordered last;
repeated rows are separate documents that share a draw; an empty table gives an empty mix; only the named columns of
the input are used to size and draw, all its columns are emitted as they are. Where the input has a column by the name of
an added one (``mix_size`` ...), the added one gets underscores behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, fresh

#: Characters that separate words: space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: Names of the added columns.
MADE = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """sized (source, size) -> source, source_size, weight, target. One row a source, in a written table.

    Sources are ranked by range partition and per-partition counts, never in one task; the water-filling loop keeps two
    sums in the driver and stops when no further source reaches its cap.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = Written(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    counts = ranged.df.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        ranged.df.join(F.broadcast(counts), "_part")  # a row a range partition
        .withColumn("_rank", F.col("_ahead") + place - 1)
        .withColumn("weight", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most_repeats)))
        .select("source", "source_size", "weight", "_cap")
    )
    table = Written(ranked)
    ranged.drop()
    total, open_weight = table.df.agg(F.sum("source_size"), F.sum("weight")).first()
    total, spare, level, closed = float(total or 0), float(total or 0), 0.0, -1
    while open_weight:
        level = spare / open_weight
        full = F.col("_cap") <= F.col("weight") * F.lit(level)
        row = table.df.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if row[0] == closed:
            break
        closed, spare, open_weight = row[0], total - float(row[1] or 0), row[2]
    return table.df.select(
        "source", "source_size", "weight", F.least(F.col("_cap"), F.col("weight") * F.lit(level)).alias("target")
    )


def draw(key: Column, seed: str) -> Column:
    """Uniform in [0, 1): the first 52 bits of an MD5 of the seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixed_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    seed: str = SEED,
    keep_columns: bool = True,
) -> DataFrame:
    """Every row with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` (0 or more).

    Without ``keep_columns``: only doc_id and source of the input, under these names.
    """
    sized = docs.select(F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    targets = source_targets(sized, weights, most_repeats)
    kept = docs.columns if keep_columns else [doc_id, source]
    size, whole, target, copies = (fresh(docs.columns, x) for x in MADE)
    rate = F.least(F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0), F.lit(float(most_repeats)))
    extra = (draw(F.col(f"d.{_quoted(doc_id)}"), seed) < rate - F.floor(rate)).cast("int")
    sized = docs.select(*map(_quoted, kept), word_count(F.col(text)).alias(size))  # texts move on only where they are kept
    return (
        sized.alias("d")
        .join(targets.alias("t"), F.col(f"d.{_quoted(source)}").cast("string").eqNullSafe(F.col("t.source")), "left")
        .select(
            *[f"d.{_quoted(c)}" for c in kept],
            F.col(f"d.{size}").alias(size),
            F.col("t.source_size").alias(whole),
            F.col("t.target").alias(target),
            (F.floor(rate) + extra).cast("int").alias(copies),
        )
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document's rows, repeated ``mix_copies`` times, with the columns of ``docs``."""
    copies = F.col(fresh(docs.columns, MADE[3]))
    again = F.explode(F.sequence(F.lit(1), copies)).alias(fresh(docs.columns, "_copy"))
    columns = list(map(_quoted, docs.columns))
    return mixed_counts(docs, **how).filter(copies > 0).select(*columns, again).select(*columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed_counts(docs, keep_columns=False).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0 * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(3.0 * source_size) OVER o, 0) AS caps_before,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_from
  FROM s WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((total - caps_before) / w_from, cap / w) FILTER (WHERE (total - caps_before) / w_from < cap / w) AS level FROM r
), t AS (
  SELECT source, source_size, least(cap, w * coalesce(level, 1e300))::DOUBLE AS target FROM r, l
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
          / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source,
     LATERAL (SELECT CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0)::DOUBLE ELSE 0.0::DOUBLE END AS rate) x
"""
