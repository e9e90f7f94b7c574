"""Operator 6: quality classifier, a generalised additive model with pairwise interactions.

Features are whole-text statistics. Training bins each by quantiles of a bounded sample of labelled rows and boosts
cyclically: in every round each feature in turn gets a shallow tree on its bins (a few leaves, fitted to the current
gradient), added with a small step to its lookup table; then the most useful feature pairs get two-way tables the same
way. A score is a logistic of bin look-ups that are added, vectorised over a batch.

Only feature rows (at most SAMPLE of them, 15 numbers each) reach the driver; labels, ids, lang and source are never
features.

Defined cases: null text counts as empty and is scored like any text; null labels are not learned from; label rows
that repeat are learned once, of documents with one id the one with the smallest features; without labelled rows every score is 0.5; an empty table gives an empty
result; extra columns are ignored, or kept as they are where the operator filters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_bytes

SAMPLE = 40_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, STEP, LEAVES, L2 = 48, 12, 120, 40, 6, 0.15, 4, 4.0
THRESHOLD = 0.7
SCORE = "quality_score"

_PLAIN = b".,;:'\"-()?"
_GROUPS = np.full(256, 3, np.int64)  # 0 letter lower, 1 letter upper, 2 digit, 3 other sign, 4 space, 5 plain mark, 6 high byte
for _c in range(256):
    _ch = bytes([_c])
    _GROUPS[_c] = (
        6 if _c >= 128 else 0 if _ch.islower() else 1 if _ch.isupper() else 2 if _ch.isdigit() else 4 if _ch.isspace() else 5 if _ch in _PLAIN else 3
    )
FEATURES = (
    "words", "word_bytes", "letters", "signs", "upper", "digits", "marks", "distinct", "same_as_last", "odd_endings",
    "bars", "exclaims", "line_repeats", "short_words", "words_a_line",
)


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    by = np.bincount(_GROUPS[np.frombuffer(text, np.uint8)], minlength=7) if text else np.zeros(7)
    solid = max(size - by[4], 1)
    lines = text.split(b"\n")
    same = sum(map(bytes.__eq__, words, words[1:]))
    odd = sum(text.count(x) for x in (b"# ", b"$ ", b"% ", b"& ", b"* ", b"! ", b"| ", b"~ ", b"^ "))
    some = max(n, 1)
    return [
        np.log1p(n),
        solid / some,
        (by[0] + by[1] + by[6]) / solid,
        by[3] / solid,
        by[1] / max(by[0] + by[1] + by[6], 1),
        by[2] / solid,
        by[5] / some,
        len(set(words)) / some**0.9,
        same / some,
        odd / some,
        text.count(b"|") / some,
        text.count(b"!") / some,
        1 - len(set(lines)) / len(lines),
        sum(map((4).__gt__, map(len, words))) / some,
        np.log1p(n / len(lines)),
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _tree(gain_g: np.ndarray, gain_h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin of one axis: up to LEAVES leaves by best-first splits of gradient histograms."""
    value = lambda g, h: g * g / (h + L2)
    cg, ch = np.concatenate([[0], np.cumsum(gain_g)]), np.concatenate([[0], np.cumsum(gain_h)])
    leaves = [(0, len(gain_g))]

    def best(lo, hi):
        if hi - lo < 2:
            return 0.0, lo
        cut = np.arange(lo + 1, hi)
        left = value(cg[cut] - cg[lo], ch[cut] - ch[lo])
        right = value(cg[hi] - cg[cut], ch[hi] - ch[cut])
        gain = left + right - value(cg[hi] - cg[lo], ch[hi] - ch[lo])
        k = int(np.argmax(gain))
        return float(gain[k]), int(cut[k])

    while len(leaves) < LEAVES:
        tries = [(*best(lo, hi), k) for k, (lo, hi) in enumerate(leaves)]
        gain, cut, k = max(tries)
        if gain <= 1e-6:
            break
        lo, hi = leaves[k]
        leaves[k : k + 1] = [(lo, cut), (cut, hi)]
    out = np.zeros(len(gain_g))
    for lo, hi in leaves:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + L2)
    return out


class Model:
    """Bin edges, one lookup table a feature, two-way tables of chosen pairs, an intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(e[:: max(1, len(e) // (COARSE - 1))]) for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if not len(x):
            return
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        raw = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-raw))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                g, h = slopes()
                size = len(self.tables[j])
                step = STEP * _tree(np.bincount(b, g, size), np.bincount(b, h, size))
                self.tables[j] += step
                raw += step[b]
        wide = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T, strict=True)]
        size = [len(e) + 1 for e in self.coarse]
        g, h = slopes()
        gains = []
        for i in range(len(bins)):
            for j in range(i + 1, len(bins)):
                cell = wide[i] * size[j] + wide[j]
                cg, ch = np.bincount(cell, g, size[i] * size[j]), np.bincount(cell, h, size[i] * size[j])
                gains.append((float((cg**2 / (ch + L2)).sum()), i, j))
        chosen = [(i, j, np.zeros((size[i], size[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in chosen:
                g, h = slopes()
                cell = wide[i] * size[j] + wide[j]
                cg = np.bincount(cell, g, table.size).reshape(table.shape)
                ch = np.bincount(cell, h, table.size).reshape(table.shape)
                step = np.zeros_like(table)  # a split of one axis, then a tree on the other in each half
                first = _tree(cg.sum(1), ch.sum(1))
                for v in np.unique(first):
                    step[first == v] = _tree(cg[first == v].sum(0), ch[first == v].sum(0))
                table += STEP * step
                raw += STEP * step[wide[i], wide[j]]
        self.pairs = chosen

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            raw += t[np.searchsorted(e, c, "right")]
        for i, j, table in self.pairs:
            raw += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-raw))


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _measured(batches):
    for batch in batches:
        x = _matrix(text_bytes(batch.column(2)))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the ``sample`` labelled rows outside the held-out fold whose hashed ids come first."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("y")
    ).distinct()
    order = F.md5(F.col("_id").cast("string").cast("binary"))
    picked = known.filter(~held_out(F.col("_id"))).orderBy(order, "_id", "y").limit(sample)
    rows = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    found = rows.select("_id", "y", F.col("text").cast("string")).mapInArrow(_measured, "id long, y double, x array<double>")
    found = found.groupBy("id", "y").agg(F.min("x").alias("x")).select("y", "x").toArrow()  # at most ``sample`` rows
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = found.column("y").to_numpy()
    order = np.lexsort((*x.T, y))
    return Model(x[order], y[order])


def _scored(text: int, name: str, sent):
    def run(batches):
        model = Model.__new__(Model)
        model.__dict__.update(sent.value)  # plain arrays: broadcasts are pickled by reference to modules
        for batch in batches:
            score = model.score(_matrix(text_bytes(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return run


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score (with underscores behind the name where ``docs`` has such a column)."""
    score = fresh(docs.columns, SCORE)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_scored(docs.columns.index("text"), score, sent), schema)


def keep_quality(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with the columns of ``docs``."""
    return score_quality(docs, model).filter(F.col(fresh(docs.columns, SCORE)) >= least).drop(fresh(docs.columns, SCORE))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
