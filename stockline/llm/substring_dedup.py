"""Substring deduplication by grouping equal windows, in place of relative Lempel-Ziv parsing.

The corpus is its own reference, indexed in blocks. A seed (the smallest 8-gram hash
of each window of 20 words) decides the block of the windows it stands in, so equal
passages meet in one block wherever they occur. Each block holds its windows with
document and place and groups them by hash; all but those at the first place go. No
longest match is sought: a factor is only the union of such windows that touch. A window
belongs to one block and is checked there, so none is missed. A document's factors,
joined, are its duplicate spans.

Each task first reduces its own rows: of windows equal within a slab only the first goes
to a block, the others are already known to start earlier. A passage that a third of all
documents share therefore reaches its block once per slab, not once per document.

A seed that stands in very many different windows (a common phrase in ever new surroundings)
would make its block large. Such seeds are counted on a sample of ``SAMPLE`` of the
documents and get several blocks, among which the window's own hash decides: equal windows
still meet, whatever the sample saw. The list of such seeds has at most ``MOST_SPLIT``
entries, as each stands for that share of the sample.

A block compares seed hash and window hash; both are made of the same 64-bit word hashes, so two
words that share one would count as one word.

Defined results: null and empty texts have no words; texts with fewer than 20 words keep
all; a window goes only if an equal one has a smaller ``doc_id``, or the same and an earlier
start, so rows that repeat id and text keep what one of them would, and rows of one
``doc_id`` with different texts are each cut at their own places; documents with a null
``doc_id`` keep all and take no part; an empty table gives an empty one; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stockline.llm.scan import DARK, U64, Words, covered, grams, slabs, utf8, window_min
from stockline.llm.store import keep

WINDOW = 20
SEED_WORDS = 8
BLOCK_BYTES = 12 << 20    # text whose windows one block is meant to index
SLAB = 8 << 20            # text that a task reduces at once
SAMPLE = 1 / 256          # documents in which frequent seeds are counted
SPLIT = 4                 # a seed with more than this part of a block gets several
MOST_SPLIT = 1 << 18
_PARTS = "block long, ready boolean, seeds binary, windows binary, docs binary, copies binary, starts binary"


class _Slab:
    """Windows of a few texts: seed hash, window hash, document, copy and start of each."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, ids: np.ndarray, copies: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(data, offsets, DARK)
        self.size += len(data)
        own, text, seeds, windows = _windows(words)
        if len(own):
            self.parts.append((seeds, windows, ids[text], copies[text], (own - words.first[text]).astype(np.int64)))


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, text number, seed hash and window hash of each window that lies in one text."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    h = words.hashes()
    windows, seeds = grams(h, WINDOW), window_min(grams(h, SEED_WORDS), WINDOW - SEED_WORDS + 1)
    text = words.text_of()
    own = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :])
    return own, text[own], seeds[own], windows[own]


def frequent_seeds(source: DataFrame, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds that would overfill a block, sorted, and how many blocks each gets."""
    none = np.zeros(0, U64), np.zeros(0, U64)
    if blocks == 1:
        return none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slabs(offsets):
                _, _, seeds, windows = _windows(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], DARK))
                # Equal windows count once: a slab sends them once.
                seed, n = np.unique(seeds[np.unique(windows, return_index=True)[1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n.astype(np.int64))], names=["seed", "n"])

    rows = source.select("text").sample(SAMPLE, 17).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    counts, _ = keep(rows, "seed-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    part = max(total / blocks / SPLIT, total / MOST_SPLIT, 16.0)  # below sixteen, chance alone
    found = counts.where(F.col("n") > part).toPandas()
    seeds, parts = found["seed"].to_numpy(np.int64).view(U64), np.ceil(found["n"].to_numpy(float) / part).astype(U64)
    order = np.argsort(seeds)
    return seeds[order], np.minimum(parts[order], U64(blocks))


def _block_of(seeds: np.ndarray, windows: np.ndarray, blocks: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, parts = frequent
    shift = np.zeros(len(seeds), U64)
    if len(known):
        at = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
        split = known[at] == seeds
        shift[split] = windows[split] % parts[at[split]]
    return ((seeds % U64(blocks) + shift) % U64(blocks)).astype(np.int64)


def _by_place(seeds, windows, docs, copies, starts) -> tuple[np.ndarray, np.ndarray]:
    """The windows at the first place of their value, each copy's once, and those at a later place."""
    order = np.lexsort((copies, starts, docs, windows) if copies.any() else (starts, docs, windows))
    w, s, d, c, t = windows[order], seeds[order], docs[order], copies[order], starts[order]
    new, again = np.ones(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
    again[1:] = ~new[1:] & (d[1:] == d[:-1]) & (c[1:] == c[:-1]) & (t[1:] == t[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    earliest = (d == d[head]) & (t == t[head])  # an equal place is not an earlier one
    return order[earliest & ~again], order[~earliest]


def _factors(docs: np.ndarray, copies: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a document joined: its number, copy and ``begin, end`` words of each factor."""
    if len(docs) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int32)
    order = np.lexsort((starts, copies, docs))
    d, c, s = docs[order], copies[order], starts[order]
    breaks = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (s[1:] > s[:-1] + WINDOW))))
    stop = np.concatenate((breaks[1:], [len(d)])) - 1
    return d[breaks], c[breaks], np.stack((s[breaks], s[stop] + WINDOW), axis=1).astype(np.int32)


def _by_group(docs: np.ndarray, copies: np.ndarray, pairs: np.ndarray, groups: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Factors of many documents as one row per group of documents."""
    group = (docs.view(U64) % U64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))).tolist() if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        rows = order[a:b]
        yield int(group[rows[0]]), docs[rows].tobytes(), copies[rows].tobytes(), pairs[rows].tobytes()


def _emit(slab: _Slab, blocks: int, frequent: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = ["block", "ready", "seeds", "windows", "docs", "copies", "starts"]
    if not slab.parts:
        return
    seeds, windows, docs, copies, starts = (np.concatenate(x) for x in zip(*slab.parts))
    kept, again = _by_place(seeds, windows, docs, copies, starts)
    known = _factors(docs[again], copies[again], starts[again])
    kept = np.sort(kept)  # back to text order, in which documents and starts repeat or count up
    seeds, windows, docs, copies, starts = seeds[kept], windows[kept], docs[kept], copies[kept], starts[kept]
    block = _block_of(seeds, windows, blocks, frequent)
    by_block = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], block[by_block][1:] != block[by_block][:-1]))).tolist()
    for a, b in zip(edges, [*edges[1:], len(by_block)]):
        rows = by_block[a:b]
        values = (seeds[rows], windows[rows], docs[rows], copies[rows], starts[rows].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block[rows[0]]], pa.int64()), pa.array([False]), *(pa.array([x], pa.binary()) for x in _packed(*values))], names=names)
    for group, ids, own, pairs in _by_group(*known, blocks):  # passed through by the block of that number
        yield pa.RecordBatch.from_arrays(
            [pa.array([group], pa.int64()), pa.array([True]), *(pa.array([x], pa.binary()) for x in (None, None, ids, own, pairs))], names=names)


def _packed(seeds, windows, docs, copies, starts) -> tuple[bytes, ...]:
    """A run is consecutive windows of one seed in one document; only its windows are listed singly."""
    new = np.ones(len(seeds), dtype=bool)
    new[1:] = (seeds[1:] != seeds[:-1]) | (docs[1:] != docs[:-1]) | (copies[1:] != copies[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, len(seeds))).astype(np.int32)
    own = copies[at].tobytes() if copies.any() else b""
    return seeds[at].tobytes(), windows.tobytes(), docs[at].tobytes(), own, np.stack((starts[at], lengths)).tobytes()


def _unpacked(seeds: bytes, windows: bytes, docs: bytes, copies: bytes, starts: bytes) -> tuple[np.ndarray, ...]:
    begin, lengths = np.frombuffer(starts, np.int32).reshape(2, -1)
    offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = np.frombuffer(copies, np.int64) if copies else np.zeros(len(lengths), np.int64)
    return np.repeat(np.frombuffer(seeds, U64), lengths), np.frombuffer(windows, U64), np.repeat(np.frombuffer(docs, np.int64), lengths), np.repeat(own, lengths), np.repeat(begin, lengths) + offset


def _block_task(table: pa.Table, groups: int) -> pa.Table:
    """The factors that a block finds, and those that slabs knew already, by group of documents."""
    ready = table.filter(table.column("ready"))
    rows = table.filter(pc.invert(table.column("ready")))
    out = list(zip([table.column("block")[0].as_py()] * ready.num_rows, *(ready.column(n).to_pylist() for n in ("docs", "copies", "starts"))))
    if rows.num_rows:
        columns = (rows.column(n).to_pylist() for n in ("seeds", "windows", "docs", "copies", "starts"))
        seeds, windows, docs, copies, starts = (np.concatenate(x) for x in zip(*(_unpacked(*r) for r in zip(*columns))))
        _, later = _by_place(seeds, windows, docs, copies, starts)
        out += _by_group(*_factors(docs[later], copies[later], starts[later]), groups)
    return pa.table({"grp": pa.array([r[0] for r in out], pa.int64())} | {n: pa.array([r[i] for r in out], pa.binary()) for i, n in enumerate(("docs", "copies", "pairs"), 1)})


def _group_task(table: pa.Table) -> pa.Table:
    """One row per document and copy: all its factors."""
    docs, copies = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(n).to_pylist()]) for n in ("docs", "copies"))
    pairs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in table.column("pairs").to_pylist()])
    order = np.lexsort((pairs[:, 0], copies, docs))
    docs, copies, pairs = docs[order], copies[order], pairs[order]
    heads = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (copies[1:] != copies[:-1])))).tolist()
    spans = [pairs[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(docs)])]
    return pa.table({"own_id": pa.array(docs[heads], pa.int64()), "own_copy": pa.array(copies[heads], pa.int64()), "spans": pa.array(spans, pa.binary())})


def duplicate_spans(docs: DataFrame, blocks: int) -> DataFrame:
    """``own_id, own_copy, spans`` of ``doc_id, copy, text``: a text's factors, each of at least ``WINDOW`` words, as int32 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab = _Slab()
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = utf8(batch.column(2))
            for i, j in slabs(offsets):
                slab.add(ids[i:j], copies[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if slab.size >= SLAB:
                    yield from _emit(slab, blocks, frequent)
                    slab = _Slab()
        yield from _emit(slab, blocks, frequent)

    source = docs.select("doc_id", "copy", "text").where("doc_id IS NOT NULL")
    frequent = frequent_seeds(source, blocks)
    found = source.mapInArrow(run, _PARTS).groupBy("block").applyInArrow(lambda t: _block_task(t, blocks), "grp long, docs binary, copies binary, pairs binary")
    return found.groupBy("grp").applyInArrow(_group_task, "own_id long, own_copy long, spans binary")


def keep_words(words: list[bytes], spans: bytes) -> tuple[list[bytes], int]:
    """The words outside the spans, and how many were removed."""
    pairs = np.frombuffer(spans, np.int32).reshape(-1, 2)
    if len(pairs) == 0:
        return words, 0
    gone = covered(len(words), pairs[:, 0], pairs[:, 1] - pairs[:, 0])
    return list(compress(words, (~gone).tolist())), int(gone.sum())


def with_copies(docs: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, copy, text`` and the bytes of all texts; ``copy`` is a hash of the text where one id has several, else zero."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = F.xxhash64("text")
    ids, _ = keep(rows.groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.sum(F.octet_length("text")).alias("size")), "substring-ids")
    several = ids.where("doc_id IS NOT NULL AND low <> high").select(F.col("doc_id").alias("several_id"))
    size = ids.agg(F.sum("size")).first()[0] or 0
    if several.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("copy"), "text"), size
    both = rows.join(several, F.col("doc_id") == F.col("several_id"), "left")
    return both.select("doc_id", F.when(F.col("several_id").isNotNull(), own).otherwise(F.lit(0)).cast("long").alias("copy"), "text"), size


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, text`` (the words that stay, one space between), ``n_words, n_removed, kept_sha256``."""
    rows, size = with_copies(docs)
    found = duplicate_spans(rows, max(1, -(-size // BLOCK_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, digests = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()  # of bytes: ASCII white space only
                kept, removed = keep_words(words, spans.as_py() or b"")
                joined = b" ".join(kept)
                texts.append(joined.decode())
                n_words.append(len(words))
                n_removed.append(removed)
                digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "text", "n_words", "n_removed", "kept_sha256"])

    both = rows.join(found, (F.col("doc_id") == F.col("own_id")) & (F.col("copy") == F.col("own_copy")), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
