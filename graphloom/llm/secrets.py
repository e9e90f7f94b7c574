r"""Operator 9: secret scan by patterns and token efficiency.

Three base patterns (assignments to secret-like names, access-key ids, long lower-case hex runs) are reported as they
stand. The token-efficiency test adds strings that no base span covers: runs of at least LEAST key characters with a
letter that take few characters a token under a public byte-pair vocabulary, as random strings do and words do not.
Known digests (hex of a digest's length, UUIDs) and identifiers (dashed words of the vocabulary with dates, versions or
numbers; strings without a letter) are excluded.

The vocabulary file is read by the driver (at most MOST_BYTES) and broadcast.

Offsets are code points of the whole text, ends exclusive. Defined cases: null or empty text has no spans; repeated
rows are scanned alike; an empty table gives an empty result; extra columns are ignored; a text of any length is
scanned whole.
"""

from __future__ import annotations

import base64
import os
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_BYTES = 16 << 20
LEAST = 16
MOST_RATIO = 2.0
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
_NEEDLES = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_KEY = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")
_DIGEST = re.compile(
    rb"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    rb"|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})"
)
_NAME = re.compile(rb"[A-Za-z]*([/_-][A-Za-z]+)*([/_-]?v?[0-9]{1,4}){0,4}|[0-9/_+-]+")
_CLASS = np.zeros(256, bool)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level 50k vocabulary.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(text: bytes, encoder, most_ratio: float) -> bool:
    body = text.rstrip(b"=")
    if not re.search(rb"[A-Za-z]", body) or _DIGEST.fullmatch(body):
        return False
    if len(text) > most_ratio * len(encoder.encode_ordinary(text.decode())):
        return False
    return not (_NAME.fullmatch(body) and of_words(body, encoder))


def of_words(body: bytes, encoder) -> bool:
    """Do all runs of letters split into words of the vocabulary (of three letters on average)? Parts of camel-case names have three letters or more."""
    pieces = lambda w: len(encoder.encode_ordinary(" " + w.decode()))
    known = lambda w, least: len(w) >= least and (pieces(w) == 1 or len(w) >= 3 * pieces(w))
    for run in re.findall(rb"[A-Za-z]+", body):
        cased = run.islower() or run.isupper() or run.istitle()
        if run == b"v" or (cased and (known(run, 2) or known(run.lower(), 2))):
            continue
        parts = re.findall(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", run)
        if cased or not all(known(p, 3) or known(p.lower(), 3) for p in parts):
            return False
    return True


def base_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes; runs: the runs of key characters."""
    found = []
    low = text.lower()
    if any(x in low for x in _NEEDLES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for lo, hi in runs:
        if hi - lo >= 24:
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, lo, hi)]
    return found


def scan(text: bytes, runs: list[tuple[int, int]], encoder, most_ratio: float) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) in code points, in order."""
    base = base_spans(text, runs)
    taken: list[list[int]] = []  # base spans merged, in order
    for s, _, e in sorted(base):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    ends = [e for _, e in taken]
    added = []
    for lo, hi in runs:
        for m in _KEY.finditer(text, lo, hi):
            k = bisect_right(ends, m.start())  # the first one that ends behind the start
            if k < len(taken) and taken[k][0] < m.end():
                continue
            if is_random(m.group(), encoder, most_ratio):
                added.append((m.start(), 3, m.end()))
    spans = sorted([*base, *added])
    if spans and not text.isascii():
        ahead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)])
        spans = [(int(s - ahead[s]), k, int(e - ahead[e])) for s, k, e in spans]
    return spans


def _scanned(sent, least: int, most_ratio: float):
    def run(batches):
        encoder = encoding(sent.value)
        for batch in batches:
            texts = [t or b"" for t in text_bytes(batch.column(1))]
            rows = []
            for lo, hi in slices([len(t) + 1 for t in texts], 8 << 20):
                part = texts[lo:hi]
                raw = _CLASS[np.frombuffer(b"\n".join([*part, b""]), np.uint8)]
                edge = np.flatnonzero(np.diff(raw, prepend=False, append=False))
                start, stop = edge[0::2], edge[1::2]
                keep = stop - start >= least
                start, stop = start[keep], stop[keep]
                base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
                first = np.searchsorted(start, base)
                for k, text in enumerate(part):
                    runs = [(int(start[j] - base[k]), int(stop[j] - base[k])) for j in range(first[k], first[k + 1])]
                    rows.append(scan(text, runs, encoder, most_ratio))
            made = [
                pa.array([[(s, KINDS[k], e) for s, k, e in r] for r in rows], _SPANS),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "found"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def find_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    least: int = LEAST,
    most_ratio: float = MOST_RATIO,
) -> DataFrame:
    """doc_id, found array<struct<start, kind, end>>: one row for each row of ``docs``."""
    if os.path.getsize(vocabulary) > MOST_BYTES:
        raise ValueError(f"the vocabulary has more than {MOST_BYTES} bytes")
    with open(vocabulary, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(
        _scanned(sent, least, most_ratio), "doc_id long, found array<struct<start: long, kind: string, end: long>>"
    )


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(shown(F.filter("found", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )
