"""Periodic runs of words, by internal pattern matching.

A slab of whole texts becomes one sequence of word numbers, with a word of its own after
each text, so nothing repeats across texts. Prefix doubling sorts its suffixes and keeps
the rank of every block of ``2 ** k`` words, which also answers how far two places agree
to the right or left. Of a run of period ``q`` and length ``len``, the first ``len - q``
words hold a dyadic block of ``2 ** k`` words (one that starts at a multiple of that), with
``2 ** (k + 1) - 1 <= len - q < 2 ** (k + 2) - 1``; the block occurs again ``q`` words on.
So each dyadic block asks for its occurrences in the window of ``4 * 2 ** k - 2`` words
behind it: the suffixes that begin with it are a range of the suffix array, and a wavelet
tree over that array gives the next one (range successor).

Occurrences at most half a block apart mean that the block itself has that period, and
they form a progression, which is taken in one step. The progression that the block itself
begins gives one candidate, its difference. A later one gives the distances that bring the
two progressions' stretches in line at their left or right ends; only where the stretches
meet does each of its places count. Every candidate is then extended to both sides.

Equal words are found by their bytes. Memory is that of one slab (``SLAB`` bytes of text,
or one text if that is longer): some hundred bytes a word and 4 more for each doubling.

Defined results: null and empty texts have no words and no run; repeated rows each come
back; ``doc_id`` may be null; an empty table gives an empty one; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST = 12          # words of the shortest run
SLAB = 1 << 18


class Blocks:
    """Suffix array of ``ids`` and ranks of its blocks; the last word must occur nowhere else."""

    def __init__(self, ids: np.ndarray):
        n = self.n = len(ids)
        sa = np.argsort(ids, kind="stable")
        slots = np.arange(n)
        head = np.ones(n, dtype=bool)
        head[1:] = ids[sa[1:]] != ids[sa[:-1]]
        rank = np.empty(n + 1, dtype=np.int64)
        rank[n] = -1
        rank[sa] = np.maximum.accumulate(np.where(head, slots, 0))
        self.levels = [rank]  # levels[k][i]: first place in the suffix array of suffixes that begin with the 2 ** k words at i
        heads = head
        while True:
            alone = heads.copy()
            alone[:-1] &= heads[1:]
            open_ = np.flatnonzero(~alone)
            if len(open_) == 0:
                break
            at = sa[open_]
            key = rank[at] * (n + 1) + rank[np.minimum(at + (1 << (len(self.levels) - 1)), n)] + 1
            order = np.argsort(key)
            at, key = at[order], key[order]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = key[1:] != key[:-1]
            sa[open_] = at
            heads = heads.copy()
            heads[open_] = fresh
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(fresh, open_, 0))
            self.levels.append(rank)
        self.sa = sa

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from ``i`` and ``j`` on."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in reversed(range(len(self.levels))):
            rank, size = self.levels[k], 1 << k
            step = (rank[i] == rank[j]) * size
            i += step
            j += step
        return i - start

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before ``i`` and ``j``."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in reversed(range(len(self.levels))):
            rank, size = self.levels[k], 1 << k
            step = ((np.minimum(i, j) >= size) & (rank[np.maximum(i - size, 0)] == rank[np.maximum(j - size, 0)])) * size
            i -= step
            j -= step
        return start - i


class WaveletTree:
    """Range successor over a permutation of ``0 .. n - 1``, for many queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, (len(values) - 1).bit_length())
        self.zeros, self.split = [], []
        for bit in reversed(range(self.bits)):
            low = (values >> bit) & 1 == 0
            count = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(low, out=count[1:])
            self.zeros.append(count)
            self.split.append(int(count[-1]))
            values = np.concatenate((values[low], values[~low]))

    def successor(self, l: np.ndarray, r: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The smallest value that is ``x`` or more in each ``[l, r)``; ``none`` where there is none."""
        below = np.zeros(len(l), dtype=np.int64)
        a, b = l, r
        for depth, bit in enumerate(reversed(range(self.bits))):
            zeros, split = self.zeros[depth], self.split[depth]
            za, zb = zeros[a], zeros[b]
            one = (x >> bit) & 1 == 1
            below += (zb - za) * one
            a, b = np.where(one, split + a - za, za), np.where(one, split + b - zb, zb)
        below[x >> self.bits > 0] = (r - l)[x >> self.bits > 0]
        has = below < r - l
        left, a, b = below[has], l[has], r[has]
        value = np.zeros(len(left), dtype=np.int64)
        for depth, bit in enumerate(reversed(range(self.bits))):
            zeros, split = self.zeros[depth], self.split[depth]
            za, zb = zeros[a], zeros[b]
            one = left >= zb - za
            left -= (zb - za) * one
            value |= one.astype(np.int64) << bit
            a, b = np.where(one, split + a - za, za), np.where(one, split + b - zb, zb)
        out = np.full(len(l), none, dtype=np.int64)
        out[has] = value
        return out


def _block_candidates(blocks: Blocks, tree: WaveletTree, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block starts and distances at which the run around the block may repeat, from blocks of ``2 ** k`` words."""
    size, rank = 1 << k, blocks.levels[k][:-1]
    b = np.arange(0, blocks.n - size, size)
    count = np.bincount(rank, minlength=blocks.n)
    b = b[count[rank[b]] > 1]
    l, at, most = rank[b], b, 4 * size - 2
    r = l + count[l]
    while len(b):
        after = tree.successor(l, r, at + 1, blocks.n + most)
        ok = after - b <= most
        b, l, r, at, after = b[ok], l[ok], r[ok], at[ok], after[ok]
        gap = after - at
        near = 2 * gap <= size
        yield b[~near], (after - b)[~near]
        # A progression: all its places up to the end of the stretch with this period.
        o, g, own = at[near], gap[near], b[near]
        end = o + g + blocks.right(o, o + g)
        last = o + (end - o - size) // g * g
        first = o == own
        yield own[first], g[first]
        o, g, own, end, stop = o[~first], g[~first], own[~first], end[~first], np.minimum(last, b[near] + most)[~first]
        if len(o):
            own_start, own_end = own - blocks.left(own, own + g), own + g + blocks.right(own, own + g)
            start = o - blocks.left(o, o + g)
            yield own, start - own_start
            yield own, end - own_end
            meets = own_end >= start
            steps = np.maximum((stop - o) // g, 0) * meets
            nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
            yield np.repeat(own, steps), np.repeat(o - own, steps) + nth * np.repeat(g, steps)
        at = after.copy()
        at[near] = last


def find_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs in ``ids``, by start and period; its last word must occur nowhere else."""
    blocks = Blocks(ids)
    tree = WaveletTree(blocks.sa)
    found = []
    if len(blocks.levels) > 1:
        # Blocks of two words serve runs of twelve words and period six alone; shorter blocks serve none.
        b = np.arange(0, max(0, blocks.n - 7), 2)
        b = b[blocks.levels[1][b] == blocks.levels[1][b + 6]]
        found.append((b, np.full(len(b), 6)))
    for k in range(2, len(blocks.levels)):
        found.extend(_block_candidates(blocks, tree, k))
    b = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)])
    q = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
    ok = (q > 0) & (b + q < blocks.n)
    b, q = b[ok], q[ok]
    start = b - blocks.left(b, b + q)
    length = b + q + blocks.right(b, b + q) - start
    ok = length >= np.maximum(LEAST, 2 * q)
    start, length, q = start[ok], length[ok], q[ok]
    # One stretch, found with several periods, has the smallest; the others are its multiples.
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _kept(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if len(start) == 0:
        return b" ".join(words)
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(delta, start + period, 1)
    np.add.at(delta, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(delta[:-1]) == 0).tolist()])


def _slab(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """Per text: number of words, its runs, and what is left of it."""
    split = [t.split() for t in texts]  # of bytes: ASCII white space only
    known: dict[bytes, int] = {}
    number = known.setdefault
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(int((sizes + 1).sum()), dtype=np.int64)
    at = 0
    for words in split:
        ids[at : at + len(words)] = [number(w, len(known)) for w in words]
        at += len(words) + 1
    ends = first + sizes
    ids[ends] = len(known) + np.arange(len(ends))
    start, length, period = find_runs(ids)
    own = np.searchsorted(first, start, side="right") - 1
    begin = np.searchsorted(own, np.arange(len(split) + 1))
    for i, words in enumerate(split):
        mine = slice(begin[i], begin[i + 1])
        s = start[mine] - first[i]
        yield len(words), s, length[mine], period[mine], _kept(words, s, length[mine], period[mine])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, rows, size = batch.column(0), [], 0
        for i in range(batch.num_rows):
            text = (batch.column(1)[i].as_py() or "").encode()
            rows.append(text)
            size += len(text) + 1
            if size < SLAB and i + 1 < batch.num_rows:
                continue
            n, s, l, p, kept = zip(*_slab(rows))
            at = np.concatenate(([0], np.cumsum([len(x) for x in s]))).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (s, l, p)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [names.slice(i + 1 - len(rows), len(rows)), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), runs), pa.array([k.decode() for k in kept], pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])
            rows, size = [], 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words``, its ``runs`` (``start, length, period``, by start and period) and ``collapsed``, the text without repeats of periods."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _runs_of, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
