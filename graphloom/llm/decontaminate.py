r"""Operator 1: benchmark decontamination with an FM-index per training shard.

Benchmark items become phrases of ``window`` consecutive words (a shorter item is one phrase). Each task indexes its
documents' words shard by shard: every word of every document, numbered by the shard's own vocabulary, at most 2^20 words
an index; a longer run is cut in pieces that overlap by a phrase. All phrases are searched in it backward through wavelet
ranks, occurrences are located by sampled suffix positions, and removal spans are merged.

Phrases and their items are dealt into blocks of about PHRASES pairs, each a broadcast of its own; a task searches them
one after another in the index that it has built, and lets go of each. Documents are read once and not shuffled.

Words: lower-case A-Z, then runs of 0-9, a-z and every non-ASCII character. Item ids are handled as strings.

Defined cases: null, empty or wordless text has no words and no hits; null or wordless items have no phrases; an item
with null id removes spans but is not listed; repeated items count once; an empty benchmark or table gives no hits;
texts of any length are read whole; extra columns are kept as they are, and where one has the name of an added column,
the added one gets underscores behind its name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, fresh, slices, text_bytes
from .fmindex import MOST, FmIndex

WINDOW = 10
PHRASES = 100_000
SHARD_BYTES = 4 << 20

_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_ADDED = {
    "leak_words": T.LongType(),
    "leak_spans": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
    "leak_items": T.ArrayType(T.StringType()),
}
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def _phrases(window: int):
    def run(batches):
        for batch in batches:
            ids, out = [], []
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                found = words(text)
                for k in range(max(1, len(found) - window + 1) if found else 0):
                    ids.append(key)
                    out.append(b" ".join(found[k : k + window]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item", "phrase"])

    return run


class Shard:
    """The FM-index of some texts, in pieces of at most ``MOST`` words."""

    def __init__(self, texts: list[bytes | None], longest: int):
        found = [words(t) for t in texts]
        number: dict[bytes, int] = {}
        self.number = number
        self.sizes = np.array([len(w) for w in found], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # one separator after each text
        text = np.zeros(self.base[-1], np.int64)
        for k, w in enumerate(found):
            text[self.base[k] : self.base[k + 1] - 1] = np.fromiter((number.setdefault(x, len(number) + 1) for x in w), np.int64, len(w))
        self.pieces = []
        lo = 0
        while lo < len(text):
            hi = min(lo + MOST - 1, len(text))
            part = text[lo:hi]
            self.pieces.append((lo, FmIndex(np.append(part, 0) if part[-1] else part, len(number))))
            if hi == len(text):
                break
            lo = hi - longest + 1
        self.marks = np.zeros(self.base[-1] + 1, np.int64)
        self.items: list[set] = [set() for _ in texts]

    def search(self, phrases: list[list[bytes]], items: list[list[str]]) -> None:
        """Marks the words of all occurrences and notes the items."""
        by_length: dict[int, tuple[list, list]] = {}
        get = self.number.get
        for k, phrase in enumerate(phrases):
            row = list(map(get, phrase))
            if None not in row:  # a word that no text has
                ids, rows = by_length.setdefault(len(row), ([], []))
                ids.append(k)
                rows.append(row)
        for length, (ids, rows) in by_length.items():
            for lo, index in self.pieces:
                which, first, last = index.search(np.array(rows, np.int64))
                if not len(which):
                    continue
                many = last - first
                at = lo + index.locate(np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum()))
                self.marks += np.bincount(at, minlength=len(self.marks)) - np.bincount(at + length, minlength=len(self.marks))
                doc = np.searchsorted(self.base, at, "right") - 1
                for d, k in np.unique(np.stack([doc, np.repeat(np.array(ids)[which], many)], 1), axis=0):
                    self.items[d].update(items[k])

    def spans(self) -> list[list[tuple[int, int]]]:
        """Per text, merged spans of hit words."""
        found: list[list] = [[] for _ in self.sizes]
        edge = np.flatnonzero(np.diff(np.cumsum(self.marks[:-1]) > 0, prepend=False, append=False))
        for a, b in zip(edge[0::2], edge[1::2], strict=True):
            d = int(np.searchsorted(self.base, a, "right")) - 1
            found[d].append((int(a - self.base[d]), int(b - self.base[d])))
        return found


def _marked(text: int, names: list[str], longest: int, sent: list):
    def run(batches):
        only = None  # a single block stays as it is between shards
        for whole in batches:
            texts = text_bytes(whole.column(text))
            for lo, hi in slices([len(t or b"") for t in texts], SHARD_BYTES):
                batch = whole.slice(lo, hi - lo)
                shard = Shard(texts[lo:hi], longest)
                for block in sent:
                    if only is None or len(sent) > 1:
                        phrases, items = block.value
                        only = [p.split(b" ") for p in phrases], items
                    shard.search(*only)
                    if len(sent) > 1:
                        vars(block).pop("_value", None)  # read again for the next shard; one block is held at a time
                added = [
                    pa.array(shard.sizes, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in shard.spans()], _SPANS),
                    pa.array([sorted(x) for x in shard.items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    return run


def _names(docs: DataFrame) -> list[str]:
    return [fresh(docs.columns, x) for x in _ADDED]


def mark_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` with leak_words (words of the text), leak_spans (merged [start, end) in words) and leak_items (sorted)."""
    spark = docs.sparkSession
    read = benchmark.select(F.col(item_id).cast("string"), F.col(item_text).cast("string"))
    table = Written(read.mapInArrow(_phrases(window), "item string, phrase binary").distinct())
    blocks = -(-table.df.count() // PHRASES)
    sent = []
    for k in range(blocks):
        rows = table.df.filter(F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)) == k).toArrow()  # about PHRASES pairs
        held: dict[bytes, list[str]] = {}
        for phrase, item in zip(rows.column("phrase").to_pylist(), rows.column("item").to_pylist(), strict=True):
            held.setdefault(phrase, []).extend([item] * (item is not None))
        sent.append(spark.sparkContext.broadcast((list(held), list(held.values()))))
    table.drop()
    names = _names(docs)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, _ADDED.values(), strict=True))])
    return docs.mapInArrow(_marked(docs.columns.index(text), names, window, sent), schema)


def excise(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans (and what stands between them)."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for start, end in spans:
        out.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*out, text[last:]])


def _excised(text: int):
    def run(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 2).to_pylist()
            clean = [
                excise(t, [(x["start"], x["end"]) for x in s]).decode() if s else t and t.decode()
                for t, s in zip(text_bytes(batch.column(text)), spans, strict=True)
            ]
            columns = batch.columns[:-3]
            columns[text] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-3])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", **how) -> DataFrame:
    """``docs`` without its leaks: ``drop`` removes the documents that hold one, ``excise`` only the spans."""
    marked = mark_leaks(docs, benchmark, **how)
    if action == "drop":
        return marked.filter(F.size(_names(docs)[1]) == 0).drop(*_names(docs))
    return marked.mapInArrow(_excised(docs.columns.index(how.get("text", "text"))), docs.schema)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = mark_leaks(docs, benchmark)
    n_hit = F.aggregate("leak_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return marked.select(
        "doc_id",
        F.col("leak_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), x AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), l AS (SELECT DISTINCT n FROM x
), o AS (
  SELECT doc_id, p.i, x.n, x.item_id
  FROM (SELECT doc_id, l.n, unnest(range(1, len(w) - l.n + 2)) AS i, w FROM d, l WHERE len(w) >= l.n) p
  JOIN x ON x.n = p.n AND x.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
