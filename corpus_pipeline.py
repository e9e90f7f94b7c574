"""A corpus pipeline: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
``run`` writes each stage's result to the shared folder and reads it back, as a job that must survive lost executors.
Empty tables go through every stage and give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, written
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.jaccard import near_duplicates
from graphloom.llm.mixing import mix
from graphloom.llm.quality import THRESHOLD, train
from graphloom.llm.quality import keep_quality as keep
from graphloom.llm.sharding import shard


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.7) go. Null and empty texts are scored like any other."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep(docs, model, THRESHOLD)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, one row stays: the one with the smallest id.

    Rows without an id come last in that order, equal ids go by a digest of the text. Rows that share an id but belong to
    different groups all stay; rows without shingles are groups of their own; exact repeats of a row are copies of it. Extra columns stay.
    """
    row = fresh(docs.columns, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(rows, doc_id=row, width=5, num=80, den=100).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.md5(F.col("text").cast("binary")), F.col(row).alias("r"))
    keys = rows.select(row, order.alias("o")).join(groups, row)
    first = keys.groupBy("component_id").agg(F.min("o").alias("o")).select(F.col("o.r").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go; null texts hold none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), action="drop")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate says; documents without words are taken as others are.

    A null source is a source of its own, rows that share an id share their draw.
    """
    return mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of every row of the mix; null texts have 16 bytes, null ids come first."""
    return shard(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("sharding", place_in_shards),
]

#: Trained scores and similarity components over trained scores are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
