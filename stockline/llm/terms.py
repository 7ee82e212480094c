"""Hashed terms of labelled texts, and the bounded sample that classifiers are fitted on.

A classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hash of their ``doc_id``; that bound is the only limit. Their terms are counted by class
inside tasks; the terms that tell the classes apart best become columns. Scoring reads
every text whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockline.llm.scan import U64, slabs, utf8
from stockline.llm.store import keep

TRAIN_ROWS = 20_000
BITS = 18
LEAST_CHI = 15.0      # of chance alone, about one term in ten thousand gets there
_SLOTS = 64

# Terms of a slab of texts: (number of the text, hash) pairs, repeats allowed.
Terms = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def distinct_terms(terms: Terms, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, bucket)`` pairs, sorted."""
    text, h = terms(data, offsets)
    keys = np.unique(text.astype(U64) << U64(BITS) | h >> U64(64 - BITS))
    return (keys >> U64(BITS)).astype(np.int64), (keys & U64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Sample:
    """Fitted columns and the sample's rows in them: row ``i`` has columns ``cols[at[i]:at[i+1]]``."""

    column_of: np.ndarray   # bucket -> column, -1 where not chosen
    positives: np.ndarray   # per column, rows of class 1 with the term
    negatives: np.ndarray
    at: np.ndarray
    cols: np.ndarray
    label: np.ndarray
    telling: np.ndarray     # per column, whether it tells the classes apart by itself

    def rows(self, keep: np.ndarray) -> "Sample":
        """Some of the rows."""
        mine = np.flatnonzero(keep)
        sizes = self.at[mine + 1] - self.at[mine]
        cols = self.cols[np.repeat(self.at[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        return Sample(self.column_of, self.positives, self.negatives, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), cols, self.label[mine], self.telling)

    def only_telling(self) -> "Sample":
        """The telling columns alone, with the others' buckets unknown."""
        number = np.where(self.telling, np.cumsum(self.telling) - 1, -1).astype(np.int32)
        column_of = np.where(self.column_of >= 0, number[self.column_of], -1).astype(np.int32)
        stays = self.telling[self.cols]
        at = np.concatenate(([0], np.cumsum(stays)))[self.at].astype(np.int64)
        return Sample(column_of, self.positives[self.telling], self.negatives[self.telling], at, number[self.cols[stays]], self.label, self.telling[self.telling])


def _each_slab(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column(column))
    for i, j in slabs(offsets):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def training_rows(labels: DataFrame, label: str, fold: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids of the training folds; one label per id (the larger, where rows differ)."""
    usable = labels.where(fold).where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def gather(docs: DataFrame, labelled: DataFrame, terms: Terms, columns: int, frequent: int = 0, others: int = 0) -> Sample:
    """Count the sample's terms by class and bring its rows, reduced to the chosen columns, to the driver.

    ``others``: so many of the most frequent terms become columns whatever they tell.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _each_slab(batch, 1):
                text, bucket = distinct_terms(terms, data, offsets)
                at = np.searchsorted(text, np.arange(j - i + 1))
                out = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, pa.binary())], names=["label", "terms"])

    # The sample is bounded, so its ids may be broadcast; repeated documents count once each.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(labelled), "doc_id").select("label", "text")
    rows, _ = keep(texts.mapInArrow(featurise, "label int, terms binary"), "training-terms")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((3, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for label, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen[label, np.frombuffer(raw.as_py(), np.int32)] += 1
        parts = np.split(seen[:2], _SLOTS, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLOTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slot", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("n"))
        return pa.table({"slot": pa.array([table.column("slot")[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    slots = rows.mapInArrow(count, "slot int, n binary").groupBy("slot").applyInArrow(add, "slot int, n binary").collect()
    seen = np.zeros((2, 1 << BITS), dtype=np.int64)
    width = (1 << BITS) // _SLOTS
    for r in slots:
        seen[:, r["slot"] * width : (r["slot"] + 1) * width] = np.frombuffer(r["n"], np.int64).reshape(2, -1)
    classes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    telling = _choose(seen, classes.get(1, 0), classes.get(0, 0), columns, frequent)
    chosen = np.union1d(telling, _frequent(seen, others)) if len(telling) else telling
    column_of = np.full(1 << BITS, -1, dtype=np.int32)
    column_of[chosen] = np.arange(len(chosen))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (column_of[np.frombuffer(x.as_py(), np.int32)] for x in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[c >= 0].tobytes() for c in found], pa.binary())], names=["label", "cols"])

    # Sorted, so that the fit does not depend on the order in which tasks end.
    small = sorted((r["label"], bytes(r["cols"])) for r in rows.mapInArrow(reduce, "label int, cols binary").collect())
    np.random.default_rng(3).shuffle(small)
    cols = [np.frombuffer(c, np.int32) for _, c in small]
    return Sample(column_of, seen[1, chosen], seen[0, chosen], np.concatenate(([0], np.cumsum([len(c) for c in cols]))).astype(np.int64),
                  np.concatenate([*cols, np.zeros(0, np.int32)]), np.array([l for l, _ in small], dtype=np.int64), np.isin(chosen, telling))


def _frequent(seen: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` buckets with the most rows, of those with any."""
    rows = seen.sum(axis=0)
    first = np.lexsort((np.arange(len(rows)), -rows))[:n]
    return first[rows[first] > 0]


def _choose(seen: np.ndarray, n1: int, n0: int, columns: int, frequent: int) -> np.ndarray:
    """The buckets with the largest chi-square between term and class, of those that chance hardly explains.

    The ``frequent`` most frequent ones are added, since terms that mean nothing alone may mean something together.
    """
    a, b = seen[1].astype(float), seen[0].astype(float)
    n = n1 + n0
    if n1 == 0 or n0 == 0:
        return np.zeros(0, dtype=np.int64)
    c, d = n1 - a, n0 - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * n0, 1.0)
    order = np.lexsort((np.arange(len(chi)), -chi))[:columns]
    return np.union1d(order[chi[order] >= LEAST_CHI], _frequent(seen, frequent))


def score_texts(docs: DataFrame, terms: Terms, column_of: np.ndarray, score: Callable[[np.ndarray, np.ndarray, int], np.ndarray], *further: str) -> DataFrame:
    """``doc_id``, the ``further`` columns and ``score`` of every row; ``score(rows, columns, n)`` gives the scores of ``n`` texts."""
    others = [c for c in further if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in _each_slab(batch, 1):
                text, bucket = distinct_terms(terms, data, offsets)
                column = column_of[bucket]
                known = column >= 0
                out[i:j] = score(text[known], column[known], j - i)
            # A text that is asked for goes out as it came in.
            carried = [batch.column(1) if c == "text" else batch.column(2 + others.index(c)) for c in further]
            yield pa.RecordBatch.from_arrays([batch.column(0), *carried, pa.array(out)], names=["doc_id", *further, "score"])

    kinds = ", ".join(f"{c} {'string' if c == 'text' else docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *further))
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *others).mapInArrow(run, f"{kinds}, score double")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
