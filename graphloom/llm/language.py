"""Operator 5: language identification by a linear-chain conditional random field over words.

Every word has binary features: affixes of one to four bytes, byte n-grams of two and three with word boundaries, and
membership in a lexicon (the most frequent words of each language). Features are hashed into a table of weights a
language; weights and the language transitions are learned together by gradient steps on the conditional likelihood,
whose expectations come from forward-backward. Training sequences are the successive windows of labelled texts, half of
them spliced from two documents, so that transitions see switches. A text's words are labelled by forward-backward over the whole
text; the prediction is the language with the largest mean posterior, the score that mean.

Training reads a sample of rows (about PER_LANGUAGE of each language, fewer where that makes more than ROWS rows, but at
least one), their texts whole, cut into windows of WINDOW words. No language is left out. ``lang`` is only a training label.

Defined cases: null text, or one without a letter: ``und``, score 0; without training rows every row is ``und``; null
lang is not learned from; null doc_id counts as held out from nothing and teaches nothing; repeated rows are predicted
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes, written

PER_LANGUAGE, ROWS, WINDOW = 120, 7_680, 48
BUCKETS = 1 << 16
EPOCHS, RATE, LEXICON = 15, 0.5, 500
UNKNOWN = "und"
_ASCII = re.compile(rb"[A-Za-z]")
_TO_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: bytes) -> bool:
    """Is there a character of the Unicode categories L?"""
    if _ASCII.search(text):
        return True
    return not text.isascii() and any(category(c)[0] == "L" for c in text.decode() if c > "\x7f")


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and non-ASCII characters."""
    if not text.isascii():
        text = text.decode().lower().encode()
    return text.translate(_TO_WORD).split()


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint64(0xCBF29CE484222325)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.uint64(p) if np.isscalar(p) else h ^ p.astype(np.uint64)) * np.uint64(0x100000001B3)
            h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int32)


def word_features(vocabulary: list[bytes], lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Features of distinct words as (word number, feature number) pairs, sorted by word."""
    n = len(vocabulary)
    size = np.fromiter(map(len, vocabulary), np.int64, n)
    flat = np.frombuffer(b"".join(b"\x01" + w + b"\x02\x00\x00\x00" for w in vocabulary), np.uint8)
    start = np.cumsum(size + 5) - (size + 5)
    who, what = [], []
    for k in range(1, 5):  # affixes
        has = np.flatnonzero(size >= k)
        front = [flat[start[has] + 1 + j] for j in range(k)]
        back = [flat[start[has] + size[has] - j] for j in range(k)]
        who += [has, has]
        what += [_hash(1, k, *front), _hash(2, k, *back)]
    owner = np.repeat(np.arange(n), size + 5)
    for k in (2, 3):  # n-grams with both boundary marks
        at = np.flatnonzero(np.arange(len(flat)) - start[owner] + k <= size[owner] + 2)
        who.append(owner[at])
        what.append(_hash(3, k, *[flat[at + j] for j in range(k)]))
    known = np.fromiter((lexicon.get(w, -1) for w in vocabulary), np.int64, n)
    has = np.flatnonzero(known >= 0)
    who.append(has)
    what.append(_hash(4, known[has]))
    who, what = np.concatenate(who), np.concatenate(what)
    order = np.argsort(who, kind="stable")
    return who[order], what[order]


def _sums(who: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    ahead = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, 0)])
    edge = np.searchsorted(who, np.arange(n + 1))
    return ahead[edge[1:]] - ahead[edge[:-1]]


def forward_backward(ids: np.ndarray, sizes: np.ndarray, emit: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Posteriors of each word of sequences laid end to end; with ``pairs``, also expected transitions.

    Sequences are taken side by side, longest first; each step handles those that are still running.
    """
    k = emit.shape[1]
    local = np.exp(emit - emit.max(1, keepdims=True))
    step = np.exp(trans - trans.max())
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    most = int(sizes.max()) if len(sizes) else 0
    running = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(most), "right")
    alpha = np.empty((len(ids), k))
    a = None
    for t in range(most):
        live = running[t]
        at = start[:live] + t
        a = local[ids[at]] if t == 0 else (a[:live] @ step) * local[ids[at]]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    total = np.zeros((k, k))
    b = np.ones((0, k))
    for t in range(most - 1, -1, -1):
        live = running[t]
        at = start[:live] + t
        if len(b) < live:
            b = np.concatenate([b, np.ones((live - len(b), k))])
        here = alpha[at] * b
        here /= here.sum(1, keepdims=True)
        if t:
            ahead = local[ids[at]] * b
            if pairs:
                left = alpha[at - 1]
                norm = (left @ step * ahead).sum(1, keepdims=True)
                total += (left / norm).T @ ahead * step
            b = ahead @ step.T
            b /= b.sum(1, keepdims=True)
        alpha[at] = here
    return alpha, total


class Tagger:
    def __init__(self, langs: list[str], lexicon: dict[bytes, int]):
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros((BUCKETS, len(langs)))
        self.trans = np.zeros((len(langs), len(langs)))

    def fit(self, sequences: list[list[bytes]], labels: list[np.ndarray]) -> None:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for s in sequences for w in s], np.int64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        gold = np.concatenate(labels)
        k, n = len(self.langs), len(number)
        who, what = word_features(list(number), self.lexicon)
        seen = np.stack([np.bincount(ids, gold == j, n) for j in range(k)], 1)
        inside = np.ones(len(ids), bool)
        inside[(np.cumsum(sizes) - sizes)] = False
        at = np.flatnonzero(inside)
        moves = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k).astype(float)
        norm_w, norm_t = np.full((BUCKETS, 1), 1e-6), np.full((k, k), 1e-6)
        for _ in range(EPOCHS):
            emit = _sums(who, self.weights[what], n)
            post, pairs = forward_backward(ids, sizes, emit, self.trans, pairs=True)
            miss = seen - np.stack([np.bincount(ids, post[:, j], n) for j in range(k)], 1)
            slope = np.stack([np.bincount(what, miss[who, j], BUCKETS) for j in range(k)], 1) - 0.01 * self.weights
            norm_w += (slope**2).sum(1, keepdims=True)
            self.weights += RATE * slope / np.sqrt(norm_w)
            turn = moves - pairs - 0.01 * self.trans
            norm_t += turn**2
            self.trans += RATE * turn / np.sqrt(norm_t)

    def label(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        known = [bool(t) and has_letter(t) and bool(self.langs) for t in texts]
        found = [words(t) if ok else [] for t, ok in zip(texts, known, strict=True)]
        number: dict[bytes, int] = {}
        sizes = np.array([len(w) for w in found], np.int64)
        ids = np.fromiter((number.setdefault(w, len(number)) for s in found for w in s), np.int64, int(sizes.sum()))
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = np.flatnonzero(sizes)
        if not len(rows):
            return langs, scores
        who, what = word_features(list(number), self.lexicon)
        emit = _sums(who, self.weights[what], len(number))
        post, _ = forward_backward(ids, sizes[rows], emit, self.trans)
        mean = np.add.reduceat(post, np.cumsum(sizes[rows]) - sizes[rows], 0) / sizes[rows, None]
        for r, m in zip(rows, mean, strict=True):
            langs[r], scores[r] = self.langs[int(m.argmax())], float(min(1.0, m.max()))
        return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _windows(batches):
    """All windows of a text's words, one after another."""
    for batch in batches:
        ids, langs, out = [], [], []
        for key, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            found = words(text or b"")
            if not found:
                continue
            for at in range(0, len(found), WINDOW):
                ids.append(key)
                langs.append(lang)
                out.append(b" ".join(found[at : at + WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), pa.array(out, pa.binary())], ["id", "lang", "words"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = ROWS) -> Tagger:
    """Learns from rows outside the held-out fold with a lang."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)
    known = known.withColumn("_draw", draw)
    spoken = F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(spoken, F.col("_draw"))).alias("_least")))
    languages = counts.count()
    if not languages:
        return Tagger([], {})
    rows = max(1.0, min(per_language, most_rows / languages))
    drawn = (F.col("_draw") < rows / F.col("_n")) | (F.col("_draw") == F.col("_least"))
    picked = known.join(F.broadcast(counts), "lang").filter(drawn).select(F.col("doc_id").cast("long"), "lang", F.col("text").cast("string"))
    rows = picked.mapInArrow(_windows, "id long, lang string, words binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["lang"], r["words"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Tagger([], {})
    windows = [(langs.index(r["lang"]), r["words"].split(b" ")) for r in rows]
    lexicon: dict[bytes, int] = {}
    for k in range(len(langs)):
        seen: dict[bytes, int] = {}
        for lang, found in windows:
            if lang == k:
                for w in found:
                    seen[w] = seen.get(w, 0) + 1
        for w in sorted(seen, key=lambda w: (-seen[w], w))[:LEXICON]:
            lexicon.setdefault(w, len(lexicon))
    rng = np.random.default_rng(7)
    mates = rng.permutation(len(windows))
    sequences, labels = [], []
    for k, (lang, found) in enumerate(windows):
        other, more = windows[mates[k]]
        if k % 2:  # spliced: part of this window, then part of another document's
            cut, rest = int(rng.integers(1, len(found) + 1)), int(rng.integers(1, len(more) + 1))
            sequences.append(found[:cut] + more[:rest])
            labels.append(np.repeat([lang, other], [cut, rest]))
        else:
            sequences.append(found)
            labels.append(np.full(len(found), lang))
    tagger = Tagger(langs, lexicon)
    tagger.fit(sequences, labels)
    return tagger


def _labelled(sent):
    def run(batches):
        tagger = Tagger.__new__(Tagger)
        tagger.__dict__.update(sent.value)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in slices([len(t or b"") for t in texts], 4 << 20):
                langs, scores = tagger.label(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, tagger: Tagger, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(tagger))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(_labelled(sent), "doc_id long, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
