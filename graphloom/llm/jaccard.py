"""Operator 7: n-gram Jaccard join by rare-first prefix filtering, and its components.

1. A pass over all texts gives each document its set size, a 128-bit digest of its set and hash-cell counts. Documents
   with equal sets form a class; only classes are joined.
2. A second pass counts document frequencies of all shingles, without a threshold. Each task cuts its documents into
   chunks and sends a chunk's shingles, sorted and packed, to the pieces of the hash space; a piece adds up all chunks
   and sends back those with two holders or more. Of a shingle that HEAVY documents of a chunk hold, only the number
   goes to the piece, and the chunk's list of holders waits for the answer elsewhere: no shingle makes a piece large.
3. A document's prefix holds its rarest shingles in the order (frequency, hash); those of one holder can meet nobody
   and are only counted. Prefix postings meet by shingle. Length, positional and suffix filters (the Hamming bound over
   the 16 cells) run where they meet. Shingles of up to SMALL holders give their pairs at once: such a bucket cannot be
   larger. Those of commoner ones first try only a star around the class with the fewest unmatched shingles for its
   size; buckets that components then already connect are dropped, and the remaining pairs between components are tried
   in blocks: the likeliest pairs of each row, then all that are left. Rows are in order of the unmatched shingles before
   the shared one, so that only blocks meet whose sums leave room for a link. No pair that could link components is left
   out, and none is verified twice in a step. With ``links`` the blocks give all pairs at once.
4. Pairs pass a finer Hamming bound first (at least 128 cells, about one for eight shingles); texts are fetched through a
   filter of at most DOC_BUCKETS hashed ids, so that few of the others move. Verification compares whole sets: the
   texts of one side meet the other side's text once per block of partners, by hashes and then by words.

A frequency is counted per task and set (copies in one task count once) and on values of 8 times as many as postings,
so that it is at least the number of classes that hold the shingle; any order by such a number is exact.

Similarity is intersection / union >= num / den over distinct shingles.

Defined cases: null, empty or blank text has no shingles, links with nothing and is its own component; fewer words than
the width make one shingle; a row with null doc_id belongs to its class but lends no id, and a class without any id is
not joined; rows that repeat an id with different texts stay apart; texts of any length are read whole; empty tables
give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, exact_shingles, mix, shingles_of, slices, text_bytes
from .components import components

CELLS = 16
FINE = 7
DOC_BUCKETS = 1 << 18
SMALL = 32
BLOCK = 384
PARTNERS = 256
NEAREST = 4
LIKELY = 1
#: Text bytes of a chunk, postings of a piece, holders in a chunk from which on only their number travels.
CHUNK, PIECE, HEAVY = 4 << 20, 1 << 19, 64
#: Most pieces, as a power of two.
PIECES = 18


def _batch(fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(fields.values()), list(fields))


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _profiles(width: int):
    def run(batches):
        for batch in batches:
            rows = []
            for found in shingles_of(text_bytes(batch.column(1)), width):
                n = len(found)
                if not n:
                    rows.append((0, b"", b"", b""))
                    continue
                bits = max(FINE, (n // 8).bit_length())  # about eight shingles a cell
                fine = np.bincount((mix(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
                cells = np.minimum(fine.reshape(CELLS, -1).sum(1), 255).astype(np.uint8)
                rows.append((n, _digest(found), cells.tobytes(), np.minimum(fine, 255).astype(np.uint8).tobytes()))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), *[pa.binary()] * 3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n", "key", "cells", "fine"])

    return run


# ---- document frequencies -------------------------------------------------------------------------------------------

LIGHT, COUNTS, HOLDERS, ROWS = range(4)
MESSAGE = "piece long, chunk long, kind int, a binary, b binary, c binary"


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ("piece", "chunk", "kind", "a", "b", "c")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _steps(values: np.ndarray) -> bytes:
    """Rising values below 2^32 as 16-bit differences where they fit, else as 32-bit ones."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.astype(np.uint16 if steps.max() < 1 << 16 else np.uint32).tobytes()


def _risen(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint16 if len(packed) == 2 * n else np.uint32).astype(np.uint64))


def _requests(width: int, bits: int, rest: int):
    """text -> packed shingle values of chunks, cut by piece: ``bits`` of a hash, the lowest ``rest`` of them in a piece."""

    def cut(values: np.ndarray):
        piece = values >> np.uint64(rest)
        edge = np.append(np.flatnonzero(np.diff(piece, prepend=piece[:1] - np.uint64(1))), len(values))
        return [(int(piece[lo]), slice(lo, hi)) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]

    def run(batches):
        low = np.uint64((1 << rest) - 1)
        seen: set[bytes] = set()
        number = 0
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for lo, hi in slices([max(128, len(t or b"")) for t in texts], CHUNK):  # under 2^16 rows
                sets, keys = [], []
                for found in shingles_of(texts[lo:hi], width):
                    key = _digest(found)
                    if len(found) and key not in seen:
                        seen.add(key)
                        sets.append(found)
                        keys.append(key)
                if len(seen) > 1 << 20:
                    seen.clear()
                if not sets:
                    continue
                chunk = (TaskContext.get().partitionId() << 32) + number
                number += 1
                sizes = np.array([len(x) for x in sets], np.int64)
                values = np.concatenate(sets) >> np.uint64(64 - bits)
                order = np.argsort(values, kind="stable")
                values, holder = values[order], np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)[order]
                first = np.flatnonzero(np.diff(values, prepend=values[:1] - np.uint64(1)))
                many = np.diff(np.append(first, len(values)))
                heavy = np.repeat(many >= HEAVY, many)
                here = number % (1 << (bits - rest))  # any piece will do
                rows = [(here, chunk, ROWS, b"".join(keys), sizes.tobytes(), None)]
                if heavy.any():
                    held, counts = values[first[many >= HEAVY]], many[many >= HEAVY].astype(np.int64)
                    rows.append((here, chunk, HOLDERS, held.tobytes(), counts.tobytes(), holder[heavy].tobytes()))
                    rows += [(p, chunk, COUNTS, held[s].tobytes(), counts[s].tobytes(), None) for p, s in cut(held)]
                    values, holder = values[~heavy], holder[~heavy]
                if len(values):
                    rows += [(p, chunk, LIGHT, _steps(values[s] & low), holder[s].tobytes(), None) for p, s in cut(values)]
                for k in range(0, len(rows), 256):
                    yield _message(rows[k : k + 256])

    return run


def _runs_of(batches, column: str):
    """The runs of equal numbers in sorted batches: (number, rows as dictionaries)."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        rows = batch.to_pylist()
        for lo, size in zip(*_runs(keys), strict=True) if len(keys) else ():
            if now is not None and keys[lo] != now:
                yield now, held
                held = []
            now = int(keys[lo])
            held += rows[lo : lo + size]
    if held:
        yield now, held


def _counted(rest: int):
    """Requests sorted by piece -> answers to chunks: values with two holders or more, their holders, their numbers."""

    def run(batches):
        for piece, rows in _runs_of(batches, "piece"):
            out = [tuple(r.values()) for r in rows if r["kind"] in (HOLDERS, ROWS)]
            rows = [r for r in rows if r["kind"] in (LIGHT, COUNTS)]
            parts, weights = [], []
            for r in rows:
                if r["kind"] == LIGHT:
                    n = len(r["b"]) // 2
                    parts.append(_risen(r["a"], n) | np.uint64(piece << rest))
                    weights.append(np.ones(n, np.int64))
                else:
                    parts.append(np.frombuffer(r["a"], np.uint64))
                    weights.append(np.frombuffer(r["b"], np.int64))
            if rows:
                place = np.unique(np.concatenate(parts), return_inverse=True)[1]
                total = np.bincount(place, np.concatenate(weights)).astype(np.int64)[place]
                edge = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                for r, values, lo, hi in zip(rows, parts, edge[:-1], edge[1:], strict=True):
                    many = total[lo:hi]
                    kept = many > 1
                    if kept.any():
                        holder = np.frombuffer(r["b"], np.uint16)[kept].tobytes() if r["kind"] == LIGHT else None
                        low = (values[kept] & np.uint64((1 << rest) - 1)).astype(np.uint32)
                        many = np.minimum(many[kept], (1 << 32) - 1).astype(np.uint32)
                        out.append((piece, r["chunk"], r["kind"], low.tobytes(), holder, many.tobytes()))
            for k in range(0, len(out), 256):
                yield _message(out[k : k + 256])

    return run


PREFIX = "key binary, prefix binary, pos binary, common binary"


def _prefixes(rest: int, num: int, den: int):
    """Answers sorted by chunk -> per set, the values of its prefix that others hold, with position and ``common``."""

    def one(rows):
        keys, sizes, waiting, counts = b"", None, None, {}
        values, many, holder = [], [], []
        for r in rows:
            if r["kind"] == ROWS:
                keys, sizes = r["a"], np.frombuffer(r["b"], np.int64)
                continue
            if r["kind"] == HOLDERS:
                waiting = r
                continue
            whole = np.frombuffer(r["a"], np.uint32).astype(np.uint64) | np.uint64(r["piece"] << rest)
            number = np.frombuffer(r["c"], np.uint32).astype(np.int64)
            if r["kind"] == COUNTS:
                counts.update(zip(whole.tolist(), number.tolist(), strict=True))
            else:
                values.append(whole)
                many.append(number)
                holder.append(np.frombuffer(r["b"], np.uint16))
        if waiting:
            held, here = np.frombuffer(waiting["a"], np.uint64), np.frombuffer(waiting["b"], np.int64)
            values.append(np.repeat(held, here))
            many.append(np.repeat(np.array([counts[x] for x in held.tolist()], np.int64), here))
            holder.append(np.frombuffer(waiting["c"], np.uint16))
        if not values:
            return []
        values, many, holder = np.concatenate(values), np.concatenate(many), np.concatenate(holder).astype(np.int64)
        order = np.lexsort((values, many, holder))
        values, many, holder = values[order], many[order], holder[order]
        shared = np.bincount(holder, minlength=len(sizes))
        pos = np.arange(len(holder)) - (np.cumsum(shared) - shared)[holder] + (sizes - shared)[holder]
        most = sizes - (num * sizes + den - 1) // den + 1
        keep = (pos < most[holder]) & _first_of(holder, values)  # of equal values, the first position
        values, many, holder, pos = values[keep], many[keep], holder[keep], pos[keep]
        edge = np.searchsorted(holder, np.arange(len(sizes) + 1))
        values, pos, common = values.astype(np.int64), pos.astype(np.int32), (many > SMALL).astype(np.uint8)
        return [
            (keys[16 * k : 16 * k + 16], values[a:b].tobytes(), pos[a:b].tobytes(), common[a:b].tobytes())
            for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))
            if a < b
        ]

    def run(batches):
        for _, rows in _runs_of(batches, "chunk"):
            found = one(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], pa.binary()) for k in range(4)], ["key", "prefix", "pos", "common"]
            )

    return run


def prefixes(texts: DataFrame, total: int, width: int, num: int, den: int) -> DataFrame:
    """key, prefix, pos, common of every set whose prefix meets another's. total: about the number of all postings."""
    pieces = min(PIECES, max(1, (total // PIECE).bit_length()))
    bits = min(pieces + 32, max(pieces + 8, (8 * total).bit_length()))
    sent = texts.mapInArrow(_requests(width, bits, bits - pieces), MESSAGE).repartition("piece").sortWithinPartitions("piece")
    back = sent.mapInArrow(_counted(bits - pieces), MESSAGE).repartition("chunk").sortWithinPartitions("chunk")
    return back.mapInArrow(_prefixes(bits - pieces, num, den), PREFIX)


# ---- candidates -----------------------------------------------------------------------------------------------------


def _postings(batches):
    """cid, n, cells, prefix, pos, common -> a row a prefix shingle."""
    for batch in batches:
        cid, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        cells, prefix, pos, common = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
        sizes = np.array([len(x) for x in common], np.int64)
        if not len(sizes):
            continue
        halves = np.frombuffer(b"".join(cells), np.int64).reshape(-1, 2)
        yield _batch(
            {
                "h": pa.array(np.frombuffer(b"".join(prefix), np.int64)),
                "common": pa.array(np.frombuffer(b"".join(common), np.uint8).astype(bool)),
                "pos": pa.array(np.frombuffer(b"".join(pos), np.int32)),
                "cid": pa.array(np.repeat(cid, sizes)),
                "n": pa.array(np.repeat(n, sizes)),
                "c1": pa.array(np.repeat(halves[:, 0], sizes)),
                "c2": pa.array(np.repeat(halves[:, 1], sizes)),
            }
        )


POSTING = "h long, common boolean, pos int, cid long, n long, c1 long, c2 long"


def _may_link(na, nb, pa_, pb, ca, cb, num, den) -> np.ndarray:
    """Length, positional and suffix filters for arrays of pairs; cells as (rows, 16) bytes."""
    need = -((-num * (na + nb)) // (num + den))
    ok = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    ok &= 1 + np.minimum(na - pa_, nb - pb) - 1 >= need
    at = np.flatnonzero(ok)
    far = np.abs(ca[at].astype(np.int16) - cb[at].astype(np.int16)).sum(1)
    ok[at] = far <= (na + nb - 2 * need)[at]
    return ok


def _arrays(table: pa.Table):
    get = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    cells = np.stack([get("c1"), get("c2")], 1).astype(np.int64).view(np.uint8).reshape(-1, CELLS)
    return get("h"), get("pos").astype(np.int64), get("cid"), get("n"), cells


def _grouped(batches, columns: list[str]):
    """Whole runs of equal leading columns of sorted batches, several at a time; a run is at most a bounded block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1] for c in columns]
        same = np.ones(batch.num_rows, bool)
        for c, x in zip(columns, last, strict=True):
            same &= batch.column(c).to_numpy(zero_copy_only=False) == x.as_py()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _small_buckets(num: int, den: int):
    """Postings sorted by (h, n): the pairs of each bucket (of at most SMALL rows) that pass the filters."""

    def run(batches):
        for table in _grouped(batches, ["h"]):
            h, pos, cid, n, cells = _arrays(table)
            sizes = _runs(h)[1]
            stop = np.repeat(np.cumsum(sizes), sizes)
            here, found, d = np.arange(len(h)), [], 0
            while len(here):
                d += 1
                here = here[here + d < stop[here]]
                here = here[n[here] * den >= n[here + d] * num]  # sorted by n: farther rows only differ more
                i, j = here, here + d
                ok = _may_link(n[i], n[j], pos[i], pos[j], cells[i], cells[j], num, den)
                found.append(np.stack([cid[i[ok]], cid[j[ok]]], 1))
            pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
            yield _batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _star_pairs(num: int, den: int):
    """A posting next to its bucket's centre: the pairs that pass the filters."""

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            wide = lambda x, y: np.stack([get(x), get(y)], 1).astype(np.int64).view(np.uint8).reshape(-1, CELLS)  # noqa: E731, B023
            ok = _may_link(get("n"), get("zn"), get("pos").astype(np.int64), get("zpos").astype(np.int64), wide("c1", "c2"), wide("z1", "z2"), num, den)
            pairs = np.unique(np.sort(np.stack([get("a")[ok], get("z")[ok]], 1), 1), axis=0)
            yield _batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Marks the first row of each run of equal keys."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([np.diff(k) != 0 for k in keys])
    return fresh


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    start = np.flatnonzero(_first_of(key))
    return start, np.diff(np.append(start, len(key)))


def _block_pairs(num: int, den: int, best: bool):
    """Rows sorted by (h, x, y): pairs between components inside each block of at most two times BLOCK rows.

    best: only the likeliest pairs of each row, by the Hamming bound, one a component and NEAREST at most; else all that
    may link.
    """

    def block(h, pos, cid, n, cells, fine, comp, side, split):
        order = np.argsort(n, kind="stable")
        sizes, labels = n[order], comp[order]
        values, place, counts = np.unique(labels, return_inverse=True, return_counts=True)
        if len(values) < 2:
            return None
        small = place != np.argmax(counts)
        minor = np.flatnonzero(small)
        left = np.searchsorted(sizes * den, sizes[minor] * num, "left")
        many = np.searchsorted(sizes * num, sizes[minor] * den, "right") - left
        i = np.repeat(minor, many)
        j = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(many.sum())
        keep = (labels[i] != labels[j]) & (~small[j] | (i < j))
        if split:
            keep &= side[order][i] != side[order][j]
        i, j = order[i[keep]], order[j[keep]]
        ok = np.flatnonzero(_may_link(n[i], n[j], pos[i], pos[j], cells[i], cells[j], num, den))
        i, j = i[ok], j[ok]
        far = _fine_far(fine, i, j)
        ok = np.flatnonzero(far <= n[i] + n[j] - 2 * -((-num * (n[i] + n[j])) // (num + den)))
        i, j, far = i[ok], j[ok], far[ok]
        if best and len(i):
            row, other, to = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([comp[j], comp[i]])
            far = np.concatenate([far, far])
            turn = np.lexsort((far, to, row))
            turn = turn[_first_of(row[turn], to[turn])]
            turn = turn[np.lexsort((far[turn], row[turn]))]
            place = np.arange(len(turn)) - np.repeat(*_runs(row[turn]))
            turn = turn[place < NEAREST]
            i, j = row[turn], other[turn]
        return np.sort(np.stack([cid[i], cid[j]], 1), 1)

    def run(batches):
        for table in _grouped(batches, ["h", "x", "y"]):
            h, pos, cid, n, cells = _arrays(table)
            comp, x, y, own = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("comp", "x", "y", "own"))
            fine = table.column("fine").to_pylist()
            new = (np.diff(h, prepend=h[:1] - 1) != 0) | (np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0)
            edges = np.append(np.flatnonzero(new), len(h))
            found = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                s = slice(lo, hi)
                pairs = block(h[s], pos[s], cid[s], n[s], cells[s], fine[lo:hi], comp[s], own[s], x[lo] != y[lo])
                if pairs is not None and len(pairs):
                    found.append(pairs)
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield _batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def _verified(width: int, num: int, den: int):
    """Sorted by (a, salt, head first): the text of ``a``, then the texts of its partners."""

    def similar(left, found):
        both = len(np.intersect1d(left, found, assume_unique=True))
        return both and both * den >= (len(left) + len(found) - both) * num

    def words(text):  # a text's set of word sequences; numbers in place of words where it is very long
        w = text.lower().split()
        return set(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else {tuple(w)}

    def same(head, exact, text):
        if len(head) + len(text) > 1 << 21:
            return similar(*exact_shingles([head, text], width))
        exact = exact[0] if exact else words(head)
        found = words(text)
        both = len(exact & found)
        return both * den >= (len(exact) + len(found) - both) * num

    def run(batches):
        now = left = head = exact = None
        for batch in batches:
            us, vs = [], []
            a, salt, b = (batch.column(k).to_pylist() for k in range(3))
            texts = text_bytes(batch.column(3))
            for k, found in enumerate(shingles_of(texts, width)):
                if b[k] is None:
                    now, left, head, exact = (a[k], salt[k]), found, texts[k], None
                    continue
                if now != (a[k], salt[k]):
                    raise ValueError("a partner without its head")
                if not similar(left, found):
                    continue
                if exact is None and len(head) < 1 << 21:
                    exact = [words(head)]
                if same(head, exact, texts[k]):  # hashes agree, so do the words
                    us.append(a[k])
                    vs.append(b[k])
            yield _batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _same_set(width: int):
    """Rows whose text has the set of its class (an id may be repeated with another text)."""

    def run(batches):
        for batch in batches:
            keys = batch.column(1).to_pylist()
            sets = shingles_of(text_bytes(batch.column(2)), width)
            ok = [_digest(x) == k for k, x in zip(keys, sets, strict=True)]
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield _batch({"cid": kept.column(0), "text": kept.column(2)})

    return run


def _fine_far(cells: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming bound of pairs of rows over their fine cells, the longer one folded to the shorter one's number.

    Counts stop at 255 before and after folding, which keeps the bound a bound.
    """
    size = np.array([len(c) for c in cells], np.int64)
    level = np.minimum(size[i], size[j])
    far = np.zeros(len(i), np.int64)
    for width in np.unique(level):
        at = np.flatnonzero(level == width)
        for part in np.array_split(at, 1 + len(at) * int(width) // (1 << 24)):
            rows, place = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
            folded = [np.frombuffer(cells[r], np.uint8).reshape(width, -1).sum(1, dtype=np.int64) for r in rows]
            table = np.minimum(np.array(folded), 255).astype(np.int16)
            far[part] = np.abs(table[place[: len(part)]] - table[place[len(part) :]]).sum(1)
    return far


def _near(num: int, den: int):
    """Pairs with sizes and fine cells of both sides: the suffix filter again, over the fine cells."""

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            cells = [*batch.column(4).to_pylist(), *batch.column(5).to_pylist()]
            need = -((-num * (na + nb)) // (num + den))
            here = np.arange(len(na))
            ok = _fine_far(cells, here, here + len(na)) <= na + nb - 2 * need
            kept = batch.filter(pa.array(ok))
            yield _batch({"a": kept.column(0), "b": kept.column(1)})

    return run


def _fine_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of class ids that pass the fine cells."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "fa", "fb")
    return pairs.mapInArrow(_near(num, den), "a long, b long")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int, near: bool) -> DataFrame:
    """The pairs (a, b) of class ids whose sets are similar. near: they have passed the fine cells."""
    pairs = pairs.distinct()
    if not near:
        pairs = _fine_pairs(pairs, classes, num, den)
    held = Written(pairs).df
    ids = held.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    asked = Written(classes.select("cid", "key", "rep").join(ids, "cid")).df
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(DOC_BUCKETS))
    hit = asked.select(bucket("rep").alias("bucket")).distinct()  # at most DOC_BUCKETS numbers
    few = docs.withColumn("bucket", bucket("doc_id")).join(F.broadcast(hit), "bucket", "left_semi").select("doc_id", "text")
    texts = few.join(asked, few["doc_id"] == asked["rep"]).dropDuplicates(["doc_id", "cid", "text"])
    texts = texts.select("cid", "key", "text").mapInArrow(_same_set(width), "cid long, text string")
    blocks = held.groupBy("a").agg(((F.count(F.lit(1)) + PARTNERS - 1) / PARTNERS).cast("int").alias("k"))
    salt = F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt")
    tails = held.join(blocks, "a").select("a", salt, "b", F.col("b").alias("cid"))
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("cid"))
    both = heads.unionByName(tails).join(texts, "cid").select("a", "salt", "b", "text")
    both = both.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return Written(both.mapInArrow(_verified(width, num, den), "u long, v long")).df


def _labelled(large: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Postings with the component of their class so far."""
    if roots is None:
        return large.withColumn("comp", F.col("a"))
    return large.join(roots, F.col("a") == F.col("node"), "left").select(*large.columns, F.coalesce("root", "a").alias("comp"))


def _excess(num: int, den: int) -> Column:
    """A posting's excess: two whose excesses add up to more than 0 cannot link.

    At the first shingle that a pair shares, all before it are unmatched on either side, and a linked pair has at most
    (na + nb) * (den - num) / (num + den) unmatched ones. The positional filter says as much and more.
    """
    return (num + den) * F.col("pos").cast("long") - (den - num) * F.col("n")


def _open_rows(large: DataFrame, roots: DataFrame | None, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Postings that may meet one of another component, dealt in blocks (h, x, y) of about two times BLOCK rows at most.

    Rows of a bucket's largest component stand last, both parts rise by ``e``, the excess. A row stays, and two blocks
    meet, only where rows of two components may link by ``e``; every such pair meets in one block of the bucket.
    """
    labelled = _labelled(large, roots).withColumn("e", _excess(num, den))
    comps = labelled.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("e").alias("e"))
    most = comps.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    other = F.when(F.col("comp") != F.col("most.comp"), F.col("e"))
    mixed = comps.join(most, "h").groupBy("h").agg(F.max("most.comp").alias("most"), F.min("e").alias("least"), F.min(other).alias("apart"))
    inside = F.col("comp") == F.col("most")
    rows = labelled.join(mixed.filter("least + apart <= 0"), "h").withColumn("inside", inside.cast("int"))
    rows = rows.filter(F.col("e") + F.when(inside, F.col("apart")).otherwise(F.col("least")) <= 0).drop("most", "least", "apart")
    level = F.signum("e") * F.floor(4 * F.log2(1 + F.abs("e") / (num + den)))  # some hundreds at most, whatever the sizes
    rows = Written(rows.withColumn("level", level.cast("int"))).df
    bucket = Window.partitionBy("h")
    before = F.sum("c").over(bucket.orderBy("inside", "level").rowsBetween(Window.unboundedPreceding, -1))
    levels = rows.groupBy("h", "inside", "level").agg(F.count(F.lit(1)).alias("c"), F.min("e").alias("least"))
    levels = levels.withColumns({"m": F.sum("c").over(bucket), "before": F.coalesce(before, F.lit(0))})
    place = lambda rank: F.expr(f"int(({rank}) * ceil(m / {BLOCK}) div m)")
    blocks = levels.withColumn("own", F.explode(F.sequence(place("before"), place("before + c - 1"))))
    blocks = blocks.groupBy("h", "own").agg(F.min("least").alias("least"), F.min(F.expr("if(inside = 0, least, null)")).alias("apart"))
    every = blocks.groupBy("h").agg(F.collect_list(F.struct("own", "least", "apart")).alias("every"))
    meets = blocks.join(every, "h").selectExpr("h", "own", "filter(every, o -> apart + o.least <= 0 or least + o.apart <= 0).own as others")
    rows = (
        rows.join(levels.select("h", "inside", "level", "c", "m", "before"), ["h", "inside", "level"])
        .withColumn("own", place("before + pmod(xxhash64(a), c)"))
        .join(meets, ["h", "own"])
        .join(classes.select(F.col("cid").alias("a"), "fine"), "a")
        .withColumn("other", F.explode("others"))
        .withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
        .select("h", "pos", F.col("a").alias("cid"), "n", "c1", "c2", "comp", "x", "y", "own", "fine")
    )
    return rows.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100, links: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``.

    links: also n_links, the number of other classes (distinct sets) that are similar to the row's; every candidate pair
    of classes is then verified once, also where components connect it already.
    """
    all_links = links
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profiles = Written(docs.mapInArrow(_profiles(width), "doc_id long, n long, key binary, cells binary, fine binary"))
    classes = Written(
        profiles.df.filter("n > 0")
        .groupBy("key")
        .agg(*[F.min(x).alias(y) for x, y in (("doc_id", "rep"), ("n", "n"))], *[F.first(x).alias(x) for x in ("cells", "fine")])
        .withColumn("cid", F.monotonically_increasing_id())
    )
    ids = classes.df.select("cid", "key", "rep", "n", "fine")
    total = classes.df.agg(F.sum("n")).first()[0] or 0
    order = prefixes(docs.select("text"), total, width, num, den).groupBy("key").agg(F.first(F.struct("prefix", "pos", "common")).alias("p"))
    named = classes.df.filter("rep is not null").select("cid", "n", "cells", "key").join(order, "key")
    postings = Written(named.select("cid", "n", "cells", "p.*").mapInArrow(_postings, POSTING))
    dealt = postings.df.filter("not common").repartition("h").sortWithinPartitions("h", "n")
    found = Written(dealt.mapInArrow(_small_buckets(num, den), "a long, b long").distinct()).df
    large = postings.df.filter("common").select("h", "pos", F.col("cid").alias("a"), "n", "c1", "c2")
    if all_links:
        blocks = _open_rows(large, None, ids, num, den).mapInArrow(_block_pairs(num, den, False), "a long, b long")
        links = _links(_fine_pairs(found, ids, num, den).union(blocks), ids, docs, width, num, den, near=True)
        return _grouped_rows(profiles.df, ids, links, True)
    row = F.struct(_excess(num, den).alias("e"), "a", "n", "pos", "c1", "c2")
    centre = large.groupBy("h").agg(F.min(row).alias("z"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    names = {"a": "z", "n": "zn", "pos": "zpos", "c1": "z1", "c2": "z2"}
    centre = centre.select("h", *[F.col(f"z.{x}").alias(y) for x, y in names.items()])
    star = large.join(centre, "h").filter("a <> z").mapInArrow(_star_pairs(num, den), "a long, b long")
    links = _links(star.union(found), ids, docs, width, num, den, near=False)
    for turn in range(LIKELY + 1):  # the likeliest pairs of what is apart, then all pairs that are left
        open_ = _open_rows(large, components(links), ids, num, den)
        between = open_.mapInArrow(_block_pairs(num, den, turn < LIKELY), "a long, b long")
        links = links.union(_links(between, ids, docs, width, num, den, near=True))
    return _grouped_rows(profiles.df, ids, links, False)


def _grouped_rows(profiles: DataFrame, ids: DataFrame, links: DataFrame, counted: bool) -> DataFrame:
    """The rows with the smallest id of their component; counted: with the number of links of their class."""
    roots = components(links)
    named = ids.select("cid", "key", "rep").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "root")
    count = []
    if counted:
        ends = links.select(F.explode(F.array("u", "v")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
        named = named.join(ends, "cid", "left")
        count = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    by_key = named.select("key", "component_id", *(["n_links"] if counted else []))
    return profiles.select("doc_id", "n", "key").join(by_key, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        *count,
    )


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100)


def op7_ngram_jaccard_links(spark, sf_dir: str) -> DataFrame:
    """The whole join: also the number of links of each document's class."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100, links=True)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s FROM w
), e AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS g FROM s
), k AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1
), f AS (SELECT e.* FROM e SEMI JOIN k USING (g)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id
   AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
