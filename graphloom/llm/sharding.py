"""Operator 8 [native]: contiguous, byte-balanced shards from global prefix sums.

Rows are ordered by doc_id (then size and checksum); the bytes before each row are known from per-range totals plus a
running sum inside its range, and a row goes to the shard in which its middle byte falls. Shards are thus contiguous
in doc_id order and their sizes differ from total / shards by at most about one document.

Defined cases: null text has 16 bytes; null doc_id sorts first; rows with the same doc_id stay next to each other, and
when one id (or null) fills a range, its rows are dealt further by checksum; rows equal in every sort column are
interchangeable; an empty table gives an empty result; extra columns are ignored, whatever their names.
The law of this operator is ``bytes``: it balances bytes, so equal texts are placed by their ids, not kept together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, prefix_sums

SHARDS = 40
OVERHEAD = 16


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot; one row for each row of ``docs``."""
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = prefix_sums(sized, "doc_id", "text_crc32", "size")
    middle = F.expr(f"((2 * before + size) * {int(shards)}) div (2 * total)")
    placed = Written(
        placed.select(
            "doc_id", "size", "text_crc32", "position", F.least(middle, F.lit(shards - 1)).cast("int").alias("shard")
        )
    ).df
    starts = placed.groupBy("shard").agg(F.min("position").alias("_start"))  # a row a shard
    return placed.join(F.broadcast(starts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("_start")).cast("long").alias("slot"),
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).withColumn("grown_shard", F.lit(None).cast("int"))


OP8_SQL = """
WITH RECURSIVE k AS (  -- the CRC-32 table from its polynomial
  SELECT n, 0 AS round, n::BIGINT AS c FROM range(256) t(n)
  UNION ALL
  SELECT n, round + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM k WHERE round < 8
), t AS (
  SELECT list(c ORDER BY n) AS crc FROM k WHERE round = 8
), b AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), d AS (
  SELECT doc_id, size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || h[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(len(h) // 2)]),
                         lambda x, y: xor(crc[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) AS text_crc32
  FROM b, t
), p AS (
  SELECT *, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         (sum(size) OVER ())::BIGINT AS total, row_number() OVER o - 1 AS position
  FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32)
), s AS (
  SELECT *, least(39, ((2 * before + size) * 40) // (2 * total))::INT AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (position - min(position) OVER (PARTITION BY shard))::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM s
"""
