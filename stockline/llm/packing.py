"""Packing by lexical retrieval.

Texts are tokenised once and written with their ids; the document frequencies behind the
BM25 weights are counted over all documents (one number per vocabulary entry). Documents
are then placed by content: the smallest hashes of a document's ``SKETCH_TERMS`` heaviest
terms, of those that another document has too, are its sketch, and a range partitioning by
sketch brings documents with equal ones together wherever they stood. Shards of a bounded
number of tokens, consecutive in that order, each build an inverted index over token ids. A
shard takes its first unused document as a seed, ranks the unused others against all terms
of the seed, and fills the seed's window with them in that order. A document that overflows
is cut, and its rest seeds the next window. A shard's open window goes on in the next shard
of its task. Neighbours whose sketches part them into different shards do not meet.

Only a task's last window can stay open; it is cut into sequences of powers of two, which
need no padding. So there is none at all.

Defined results: null and empty texts are the end id alone; repeated rows are packed once
each; an empty table gives an empty one; further columns are ignored. Sequence ids hold
the partition in the high bits, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stockline.llm.scan import U64, mix
from stockline.llm.store import forget, keep

LENGTH = 2048
END_ID = 1
SHARD_TOKENS = 1 << 21
SHARD_DOCS = 1 << 16
SKETCH_TERMS = 16     # of a document's terms, those of the largest weight decide its place
SKETCH = 3            # hashes of a sketch: documents that share the first are ordered by the next
K1, B = 1.2, 0.75
DENSE = 8             # terms in at least one of so many documents have a row of weights
FIRST = 32            # neighbours that are sorted at first
_SLOTS = 64


@lru_cache(maxsize=2)
def encoder(path: str):
    """``text -> ids`` of the byte-level BPE in a ``tokenizers`` file; its added tokens are found inside texts as that library finds them.

    Where the same vocabulary lies beside it as ranks, tiktoken gives the same ids several times as fast.
    """
    import os

    ranks = path.removesuffix(".json") + ".tiktoken"
    if path.endswith(".json") and os.path.exists(ranks):
        import json

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _documents_with(ids: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Per token, the number of documents that hold it."""
    own = np.repeat(np.arange(len(ids), dtype=U64), [len(x) for x in ids])
    keys = np.sort(own * U64(vocabulary) + np.concatenate(ids).astype(U64))
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[fresh] % U64(vocabulary)).astype(np.int64), minlength=vocabulary)


def tokenise(docs: DataFrame, path: str, vocabulary: int) -> DataFrame:
    """``doc_id, ids`` rows (uint16 or uint32), and rows ``slot, ids`` with the task's document frequencies."""
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path), np.zeros(vocabulary, dtype=np.int64)
        names = ["doc_id", "slot", "n", "ids"]
        end = np.array([END_ID], dtype=kind)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                out = [np.concatenate((encode(text.as_py() or "").astype(kind), end)) for text in some.column(1)]
                seen += _documents_with(out, vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.nulls(len(out), pa.int32()), pa.array([len(x) for x in out], pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())], names=names)
        parts = np.array_split(seen, _SLOTS)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(_SLOTS, pa.int64()), pa.array(range(_SLOTS), pa.int32()), pa.nulls(_SLOTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, slot int, n long, ids binary")


def _sum_slot(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("ids"))
    return pa.table({"slot": pa.array([table.column("slot")[0].as_py()], pa.int32()), "ids": pa.array([total.tobytes()], pa.binary())})


def sketch(ids: np.ndarray, idf: np.ndarray, frequency: np.ndarray, mean: float) -> list[int]:
    """The smallest hashes of the document's heaviest terms, of those that stand in another document too."""
    terms, tf = np.unique(ids, return_counts=True)
    shared = frequency[terms] > 1
    terms, tf = terms[shared], tf[shared]
    if len(terms) > SKETCH_TERMS:
        weight = idf[terms] * tf / (tf + K1 * (1 - B + B * len(ids) / mean))
        terms = terms[np.argsort(-weight, kind="stable")[:SKETCH_TERMS]]
    hashes = np.sort(mix(terms.astype(U64) + U64(1)) >> U64(1))[:SKETCH].tolist()
    return hashes + [(1 << 63) - 1] * (SKETCH - len(hashes))


class Index:
    """The BM25 inverted index of one shard.

    Terms that stand in at least one of ``DENSE`` documents have a row of weights over all documents, the
    others a list of postings: adding whole rows is cheaper than following long lists.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs])
        own = np.repeat(np.arange(len(docs), dtype=np.uint64), sizes)
        keys, tf = np.unique(np.concatenate(docs).astype(np.uint64) << np.uint64(16) | own, return_counts=True)
        self.n = len(docs)
        self.doc = (keys & np.uint64(0xFFFF)).astype(np.int64)
        self.term = (keys >> np.uint64(16)).astype(np.int64)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / mean))
        self.term_at = np.searchsorted(self.term, np.arange(int(self.term[-1]) + 2))
        self.by_doc = np.argsort(self.doc.astype(np.uint16), kind="stable")
        self.doc_at = np.searchsorted(self.doc[self.by_doc], np.arange(self.n + 1))
        spread = np.diff(self.term_at)
        dense = np.flatnonzero(spread * DENSE >= self.n)
        self.row_of = np.full(len(spread), -1, dtype=np.int64)
        self.row_of[dense] = np.arange(len(dense))
        rows = self.row_of[self.term]
        self.rows = np.zeros((len(dense), self.n), dtype=np.float32)
        self.rows[rows[rows >= 0], self.doc[rows >= 0]] = self.weight[rows >= 0]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for all terms of the seed."""
        terms = self.term[self.by_doc[self.doc_at[seed] : self.doc_at[seed + 1]]]
        rows = self.row_of[terms]
        rare = terms[rows < 0]
        starts, sizes = self.term_at[rare], self.term_at[rare + 1] - self.term_at[rare]
        at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return self.rows[rows[rows >= 0]].sum(axis=0) + np.bincount(self.doc[at], self.weight[at], self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, best first; ties in order."""
        scores = self.scores(seed) * unused
        found = np.flatnonzero(scores)
        # Few are taken, so few are sorted: the best, then the others.
        if len(found) > FIRST:
            least = np.partition(scores[found], len(found) - FIRST)[len(found) - FIRST]
            best = found[scores[found] >= least]
            yield from best[np.argsort(-scores[best], kind="stable")].tolist()
            found = found[scores[found] < least]
        yield from found[np.argsort(-scores[found], kind="stable")].tolist()


class Packer:
    """Fills sequences; ``rows`` are the finished pieces."""

    def __init__(self, first: int, length: int = LENGTH):
        self.length, self.sequence, self.fill = length, first, 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def room(self) -> int:
        return self.length - self.fill

    def add(self, doc: tuple, ids: np.ndarray, start: int = 0) -> None:
        """All of a document from ``start``, over as many sequences as it needs."""
        while start < len(ids):
            piece = ids[start : start + self.room()]
            self.open.append((doc, start, piece, len(ids)))
            self.fill += len(piece)
            start += len(piece)
            if self.room() == 0:
                self._close(self.open)
                self.open, self.fill = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """The open window as sequences of powers of two, largest first."""
        pieces, left = self.open, self.fill
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            part: list[tuple] = []
            while want:
                doc, start, ids, total = pieces[0]
                take = ids[:want]
                part.append((doc, start, take, total))
                want -= len(take)
                pieces = pieces[1:] if len(take) == len(ids) else [(doc, start + len(take), ids[len(take) :], total), *pieces[1:]]
            self._close(part)
        self.open, self.fill = [], 0


def fill(packer: Packer, names: list, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
    """Pack one shard."""
    index = Index(docs, idf, mean)
    unused = np.ones(len(docs), dtype=bool)
    following = 0
    while True:
        while following < len(docs) and not unused[following]:
            following += 1
        if following == len(docs):
            return
        seed = following
        unused[seed] = False
        packer.add(names[seed], docs[seed])
        # Its rest, or the whole of a short one, seeds the open window.
        while 0 < packer.fill:
            overflow = None
            for doc in index.neighbours(seed, unused):
                unused[doc] = False
                cut = len(docs[doc]) > packer.room()
                full = len(docs[doc]) >= packer.room()
                packer.add(names[doc], docs[doc])
                if full:
                    overflow = doc if cut else None
                    break
            if overflow is None or packer.fill == 0:
                break
            seed = overflow


def pack(docs: DataFrame, tokenizer: str, vocabulary: int = 50_257) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    table, path = keep(tokenise(docs, tokenizer, vocabulary), "token-ids")
    totals = table.where("slot IS NULL").agg(F.count("*"), F.sum("n")).first()
    counts = table.where("slot IS NOT NULL").select("slot", "ids").groupBy("slot").applyInArrow(_sum_slot, "slot int, ids binary").collect()
    frequency = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in sorted(counts, key=lambda r: r["slot"])]) if counts else np.zeros(vocabulary)
    n = totals[0] or 0
    mean = (totals[1] or 0) / max(1, n)
    idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))  # as long as the vocabulary, whatever the input
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            keys = np.array([sketch(np.frombuffer(x.as_py(), kind), idf, frequency, mean) for x in batch.column(1)], dtype=np.int64).reshape(-1, SKETCH)
            rows = row + np.arange(batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(k) for k in keys.T), pa.array(rows)], names=["doc_id", "ids", *places])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40)
        names, shard, size = [], [], 0

        def out():
            columns = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(doc)
                shard.append(np.frombuffer(ids.as_py(), kind))
                size += len(shard[-1])
                if size >= SHARD_TOKENS or len(shard) == SHARD_DOCS:
                    fill(packer, names, shard, idf, mean)
                    names, shard, size = [], [], 0
                    if packer.rows:
                        yield out()
        if shard:
            fill(packer, names, shard, idf, mean)
        packer.finish()
        if packer.rows:
            yield out()

    # The row number parts documents with one sketch, however many they are.
    places = [*(f"sketch_{i}" for i in range(SKETCH)), "row_no"]
    # Written, as the range partitioning reads its keys twice: once, and these alone, for the bounds.
    placed, _ = keep(table.where("slot IS NULL").select("doc_id", "ids").mapInArrow(sketched, "doc_id long, ids binary, " + ", ".join(f"{p} long" for p in places)), "placed-ids")
    forget(docs.sparkSession, path)
    tasks = max(1, -(-(totals[1] or 0) // (2 * SHARD_TOKENS)))
    return placed.repartitionByRange(tasks, *places).sortWithinPartitions(*places).select("doc_id", "ids").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
