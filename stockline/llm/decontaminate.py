"""Benchmark decontamination by winnowing.

Of every ``WINDOW - K + 1`` consecutive ``K``-gram hashes of a text the smallest is kept.
Two texts that share ``WINDOW`` consecutive words share such a hash, so the join of
training and test fingerprints misses no window. A fingerprint carries the hashes of the
windows that chose it; where it meets a test fingerprint, these extend the hit: only
windows that stand in the benchmark go on, so a ``K``-gram common to very many items
costs a document one row per own window, not one per item. Items shorter than a window
are one window of their own length ``n``; for the few lengths that occur, documents give
their ``n``-grams. Windows are compared by their own hash and their fingerprint; both are made
of the same 64-bit word hashes, so two words that share one would count as one word.

Texts are read once and never shuffled: a row per document and the fingerprints that met
a test fingerprint are all that is written. Item numbers join last, to the windows a
document was seen to hold.

The joins carry no hint: Spark broadcasts the test side while it is small and
shuffles both by hash beyond that.

Defined results: null and empty texts have no words and are never contaminated; an item
without words has no window; an item without ``item_id`` marks words, but is not counted;
several rows of one ``item_id`` are all its windows; repeated document rows each come
back, each judged by its own text; an empty table gives an empty one, an empty benchmark
clean documents; further columns are ignored by ``find`` and kept by
``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stockline.llm.scan import ALNUM, U64, Words, grams, mix, slabs, utf8, window_min
from stockline.llm.store import keep

WINDOW = 10
K = 6
_ROWS = "row_no long, doc_id long, print long, n_words long, n int, fp long, starts binary, windows binary"


def winnow(grams_of_text: np.ndarray, w: int) -> np.ndarray:
    """The smallest hash of each ``w`` consecutive ones, each kept once per run."""
    if len(grams_of_text) == 0:
        return grams_of_text
    low = window_min(grams_of_text, min(w, len(grams_of_text)))
    return low[np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))]


def _binary(at: np.ndarray, values: np.ndarray) -> pa.Array:
    """``values[at[i]:at[i+1]]`` as the bytes of row ``i``; the last row goes to the end."""
    offsets = (np.append(at, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _prints(words: Words, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """``(n, text, fp, starts, windows)`` of each fingerprint of a text, with the windows that chose it.

    Full windows of one fingerprint are consecutive: their first start, and all their
    hashes. Short ones are their own fingerprint: all their starts.
    """
    hashes, text = words.hashes(), words.text_of()
    for n in (WINDOW, *lengths):
        windows = grams(hashes, n)
        own = np.flatnonzero(text[: len(windows)] == text[n - 1 :][: len(windows)]) if len(windows) else np.zeros(0, np.int64)
        if len(own) == 0:
            continue
        fps = window_min(grams(hashes, K), WINDOW - K + 1)[own] if n == WINDOW else windows[own]
        if n < WINDOW:
            order = np.lexsort((own, fps, text[own]))
            own, fps = own[order], fps[order]
        t = text[own]
        start = (own - words.first[t]).astype(np.int32)
        at = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (fps[1:] != fps[:-1]))))
        if n == WINDOW:
            yield n, t[at], fps[at], _binary(np.arange(len(at)), start[at]), _binary(at, windows[own])
        else:
            yield n, t[at], fps[at], _binary(at, start), pa.nulls(len(at), pa.binary())


def scan_texts(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """A row of ``n`` zero for each row of ``docs``, and a row for each of its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _ROWS.split(", ")]
        first = TaskContext.get().partitionId() << 40  # a task that runs again counts alike
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slabs(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM, lower=True)
                row = first + np.arange(j - i)
                first += j - i
                # Fingerprints of these rows meet nothing; they only spread them over the partitions of a join.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(words.counts().astype(np.int64)),
                     pa.array(np.zeros(j - i, np.int32)), pa.array(mix(row.astype(U64)).view(np.int64)), pa.nulls(j - i, pa.binary()), pa.nulls(j - i, pa.binary())], names=names)
                for n, text, fp, starts, windows in _prints(words, lengths):
                    none = pa.nulls(len(text), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[text]), none, none, none, pa.array(np.full(len(text), n, np.int32)), pa.array(fp.view(np.int64)), starts, windows], names=names)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print")).mapInArrow(run, _ROWS)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, n, fp, hash`` of all windows of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item_id", "n", "fp", "hash"]
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                raw = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)
                hashes = Words(raw, np.array([0, len(raw)]), ALNUM, lower=True).hashes()
                n = min(WINDOW, len(hashes))
                if n == 0:
                    continue
                windows = grams(hashes, n)
                fps = window_min(grams(hashes, K), WINDOW - K + 1) if n == WINDOW else windows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(windows), pa.int64()), pa.array(np.full(len(windows), n, np.int32)),
                     pa.array(fps.view(np.int64)), pa.array(windows.view(np.int64))], names=names)

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "item_id long, n int, fp long, hash long")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint rows as one row per window: ``row_no, n, fp, hash, start``."""
    for batch in batches:
        n, fp = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        starts, hashes = [], []
        for k, (at, windows) in enumerate(zip(batch.column(3), batch.column(4))):
            s = np.frombuffer(at.as_py(), np.int32)
            w = np.frombuffer(windows.as_py(), np.int64) if n[k] == WINDOW else np.full(len(s), fp[k])
            starts.append(s[0] + np.arange(len(w), dtype=np.int32) if n[k] == WINDOW else s)
            hashes.append(w)
        rows = pa.array(np.repeat(np.arange(len(starts)), [len(s) for s in starts]))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(rows) for c in range(3)), pa.array(np.concatenate([*hashes, np.zeros(0, np.int64)])),
             pa.array(np.concatenate([*starts, np.zeros(0, np.int32)]))], names=["row_no", "n", "fp", "hash", "start"])


def _met(docs: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``row_no, doc_id, print, n_words`` of all documents, and ``row_no, n, fp, hash, start`` of their test windows."""
    lengths = sorted(r[0] for r in tests.where(F.col("n") < WINDOW).select("n").distinct().collect())  # at most 9 numbers
    prints = tests.select("n", "fp").distinct().withColumn("met", F.lit(True))
    met, _ = keep(scan_texts(docs, lengths).join(prints, ["n", "fp"], "left").where("met OR n = 0").drop("met"), "met-fingerprints")
    windows = met.where("n > 0").select("row_no", "n", "fp", "starts", "windows").mapInArrow(_extend, "row_no long, n int, fp long, hash long, start int")
    hits, _ = keep(windows.join(tests.select("n", "fp", "hash").distinct(), ["n", "fp", "hash"], "left_semi"), "hits")
    return met.where("n = 0").select("row_no", "doc_id", "print", "n_words"), hits


def _words_hit(places: str) -> Column:
    """How many words the ``(start, n)`` places cover, each once; ``places`` is sorted."""
    return F.expr(
        f"aggregate({places}, named_struct('till', 0, 'sum', 0L), (a, x) -> named_struct('till', greatest(a.till, x.start + x.n), "
        f"'sum', a.sum + greatest(0, x.start + x.n - greatest(a.till, x.start))), a -> a.sum)")


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    tests, _ = keep(item_windows(benchmark), "test-windows")
    rows, hits = _met(docs, tests)
    # At most as many places as a document has words and lengths.
    covered = hits.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("places")).select("row_no", _words_hit("places").alias("n_hit"))
    owners = tests.where("item_id IS NOT NULL").select("n", "fp", "hash", "item_id").distinct()
    pairs = hits.select("row_no", "n", "fp", "hash").distinct().join(owners, ["n", "fp", "hash"]).select("row_no", F.col("item_id").cast("string").alias("item")).distinct()
    named = pairs.groupBy("row_no").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    return rows.join(covered, "row_no", "left").join(named, "row_no", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    tests, _ = keep(item_windows(benchmark), "test-windows")
    rows, hits = _met(docs, tests)
    bad = rows.join(hits.select("row_no").distinct(), "row_no", "left_semi").select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct()
    bad, _ = keep(bad, "contaminated")  # written, so that texts are shuffled only where this is too large to broadcast
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["__print"]), "left_anti")
