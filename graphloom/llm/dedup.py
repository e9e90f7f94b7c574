"""Operator 10: exact deduplication by content sort.

Each task lower-cases A-Z and folds equal texts (pre-aggregation: one row a text among FOLD bytes of them). Sampled
splitters range-partition the folded rows by their normalised bytes: by the first 128 of them, and a digest where these
agree, so that a passage that starts many texts cannot fill one range. Inside a range an external sort orders the whole
normalised bytes, which puts equal texts next to each other. A pass over neighbours compares whole texts, keeps one
identifier a text and sums the group. Members then look up their group in an equi-join on two digests of the text (SHA-256
and BLAKE2b, 48 bytes together); its hot keys adaptive execution splits, no group is gathered in a task.

Defined cases: null text counts as empty; null doc_id never wins over another id and is kept only if all are null;
repeated rows (same doc_id and text) are members of one group, ``kept`` is true for each of them with the kept id; texts
of any length are compared whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

PREFIX = 128
#: Bytes of distinct texts that a task folds together.
FOLD = 32 << 20


def _key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest() + hashlib.blake2b(text, digest_size=16).digest()


def _digests(batches):
    for batch in batches:
        texts = text_bytes(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([_key((x or b"").lower()) for x in texts], pa.binary())],
            ["doc_id", "key"],
        )


def _folded(largest: bool):
    def run(batches):
        seen: dict[bytes, list] = {}
        held = 0

        def flush():
            rows = [(text[:PREFIX], hashlib.sha256(text).digest(), *x, text) for text, x in seen.items()]
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["head", "sha", "id", "n", "body"]
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                text = (text or b"").lower()
                found = seen.get(text)
                if found is None:
                    if held + len(text) > FOLD and seen:
                        yield flush()
                        seen.clear()
                        held = 0
                    held += len(text) + 100
                    seen[text] = [key, 1]
                    continue
                found[1] += 1
                if key is not None and (found[0] is None or (key > found[0]) == largest):
                    found[0] = key
        yield flush()

    return run


def _neighbours(largest: bool):
    """Rows sorted by body in, one row a distinct text out; holds one text at a time."""

    def run(batches):
        last, best, total = None, None, 0
        for batch in batches:
            out: list[tuple] = []
            ids, ns = (batch.column(k).to_pylist() for k in (0, 1))
            for key, n, body in zip(ids, ns, batch.column(2), strict=True):
                body = body.as_py()
                if body == last:
                    total += n
                    if key is not None and (best is None or (key > best) == largest):
                        best = key
                    continue
                if last is not None:
                    out.append((_key(last), best, total))
                last, best, total = body, key, n
            yield _groups(out)
        if last is not None:
            yield _groups([(_key(last), best, total)])

    return run


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))],
        ["key", "keep_id", "group_size"],
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """key, keep_id, group_size: one row a distinct normalised text. keep: ``smallest`` or ``largest`` identifier."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    largest = keep == "largest"
    folded = read.mapInArrow(_folded(largest), "head binary, sha binary, id long, n long, body binary")
    dealt = folded.repartitionByRange("head", "sha").select("id", "n", "body").sortWithinPartitions("body")
    return dealt.mapInArrow(_neighbours(largest), "key binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row for each row of ``docs``."""
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    members = read.mapInArrow(_digests, "doc_id long, key binary")
    groups = exact_groups(docs, doc_id, text, keep)
    return members.join(groups, "key").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
