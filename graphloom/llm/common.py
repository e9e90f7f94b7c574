"""Helpers shared by the corpus operators: shared-folder tables, Arrow access, global prefix sums."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Written, written  # noqa: F401  used by the operators

def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def slices(sizes: list[int], most: int):
    """(from, to) runs of rows whose sizes add up to about ``most``; a larger row is alone."""
    start = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def splitters(df: DataFrame, key: str, parts: int) -> list:
    """Bounded sampled splitters of a numeric key: at most ``parts`` - 1 values reach the driver."""
    if parts < 2:
        return []
    at = [k / parts for k in range(1, parts)]
    found = df.agg(F.percentile_approx(key, [float(x) for x in at], 10 * parts).alias("cut")).first()["cut"]
    return sorted(set(found or []))


def range_bucket(key: str, cuts: list) -> Column:
    """Number of splitters <= key (null: 0): a binary search as nested conditions."""

    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) >= F.lit(cuts[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))

    return F.when(F.col(key).isNull(), 0).otherwise(half(0, len(cuts))).cast("int")


#: Most ranges of a prefix sum; its rows are a few numbers each, so 4,096 ranges serve 10^11 of them.
RANGES = 4096


def bucket_count(spark: SparkSession) -> int:
    return max(2, min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with as many underscores behind it as set it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def prefix_sums(df: DataFrame, key: str, tie: str, value: str) -> DataFrame:
    """Adds ``before`` (sum of ``value`` over all rows ordered before), ``position`` (rows before) and the totals
    ``total`` and ``n_total``, ordered by key (null first), then by ``tie``, a number from 0 to 2^32 - 1.

    Rows are dealt to ranges of the key; those of a key that fills a range, and of null, also to 1,024 ranges of the tie.
    Only totals of ranges meet in one task (at most 2 * RANGES, and 1,024 for each of the keys that fill one). Ranges are
    pure functions of the row, so a lost task is recomputed alike. Rows equal in key and tie may swap places.
    """
    parts = bucket_count(df.sparkSession)
    cuts = splitters(df, key, parts)
    held = df.filter(F.col(key).isin(cuts)).groupBy(key).agg(F.count(F.lit(1)).alias("n")) if cuts else None
    rows = df.count()
    full = [r[0] for r in held.filter(F.col("n") * parts >= rows).collect()] if cuts else []  # at most ``parts`` keys
    alone = F.col(key).isNull() | (F.col(key).isin(full) if full else F.lit(False))
    place = F.when(F.col(key).isNull(), 0).otherwise(1 + 2 * range_bucket(key, cuts) + F.when(alone, 0).otherwise(1))
    dealt = df.withColumns({"_range": place.cast("int"), "_sub": F.when(alone, F.shiftright(F.col(tie), 22)).otherwise(0).cast("int")})
    totals = dealt.groupBy("_range", "_sub").agg(F.sum(value).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    ahead = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_range",
        "_sub",
        F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"),
        F.sum("_bytes").over(whole).alias("total"),
        F.sum("_rows").over(whole).alias("n_total"),
    )
    inside = Window.partitionBy("_range", "_sub").orderBy(F.col(key).asc_nulls_first(), F.col(tie))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.withColumn("_run", F.sum(value).over(running))
        .withColumn("_row", F.row_number().over(inside))
        .join(totals, ["_range", "_sub"])
        .withColumn("before", F.col("_before") + F.col("_run") - F.col(value))
        .withColumn("position", F.col("_ahead") + F.col("_row") - 1)
        .drop("_before", "_ahead", "_run", "_row", "_range", "_sub")
    )


# ---- vectorised words and shingles ---------------------------------------------------------------------------------

_B = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _B, np.uint64)
        up[0] = 1
        inverse = pow(int(_B), -1, 1 << 64)
        down = np.full(size, np.uint64(inverse), np.uint64)
        down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"], _POWERS["down"]


_FNV = np.uint64(0x100000001B3)
LONG_WORD = 64


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the white-space separated words of lower-cased (A-Z only) bytes.

    Hashes come from prefix sums of a polynomial and do not depend on the place of a word. Words of more than LONG_WORD
    bytes, for which texts with equal polynomials can be built, get a digest instead.
    """
    text = text.lower()
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    out = []
    block = 1 << 16  # powers of a position restart in each block of whole words
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            j = max(k + 1, int(np.searchsorted(ends, starts[k] + block, "right")))
            lo, hi = starts[k], ends[j - 1]
            up, down = _powers(int(hi - lo) + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            s, e = starts[k:j] - lo, ends[k:j] - lo
            out.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
            k = j
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[k] = int.from_bytes(hashlib.blake2b(text[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return starts, hashes


def split_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of texts (A-Z lower-cased, cut at space and U+0009 to U+000D) one after another, and each text's first."""
    found = [t.lower().split() for t in texts]
    return list(chain.from_iterable(found)), np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype(np.int64)


def _sets(h: np.ndarray, first: np.ndarray, width: int, short) -> list[np.ndarray]:
    """Per text, its sorted distinct shingle values; ``short`` gives the one of a text with fewer words."""
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            found = np.sort(h[a : b - width + 1])
            fresh = np.empty(len(found), bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            out.append(found[fresh])
        else:
            out.append(short(int(a), int(b)) if b > a else np.zeros(0, h.dtype))
    return out


def shingles_of(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its ``width``-word shingles; fewer words: the whole sequence as one."""
    out: list[np.ndarray] = []
    for lo, hi in slices([len(t or b"") + 1 for t in texts], 1 << 18):
        part = [t or b"" for t in texts[lo:hi]]
        starts, words = _words(b"\n".join(part))
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])]))
        n = max(0, len(words) - width + 1)
        with np.errstate(over="ignore"):
            h = np.full(n, np.uint64(width), np.uint64)
            for k in range(width):
                h = mix(h * _FNV + words[k : k + n])

        def short(a, b, words=words):
            one = np.full(1, np.uint64(b - a), np.uint64)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    one = mix(one * _FNV + w)
            return one

        out += _sets(h, first, width, short)
    return out


def shingles(text: bytes | None, width: int) -> np.ndarray:
    return shingles_of([text], width)[0]


def exact_shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Like ``shingles_of``, but with numbers that are equal where the words are, among these texts; no hash decides."""
    found, first = split_words(texts)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found)) + 1
    base = len(number) + 2
    ids = np.concatenate([ids, np.zeros(width, np.int64)])
    rank = ids[: len(found)]
    for k in range(1, width):
        rank = np.unique(rank * base + ids[k : k + len(found)], return_inverse=True)[1]
    brief: dict[tuple, int] = {}  # texts of fewer words
    short = lambda a, b: np.array([-1 - brief.setdefault(tuple(ids[a:b].tolist()), len(brief))])
    return _sets(rank, first, width, short)
