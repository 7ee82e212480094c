"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and their beginnings, so that a stem counts with any ending. Besides a
weight, each has a vector of ``FACTORS`` numbers; the product of two terms' vectors is the
weight of their meeting in one text, which a sum of single weights cannot express. Both
are learnt together by adaptive gradient steps on the log loss.

Two machines are fitted: one over the terms that tell the classes apart by themselves, one
over the ``OTHERS`` most frequent terms as well, as terms that are neutral alone may be
toxic together. Most of those terms are noise, so the wider machine scores only where its
loss on ``1 / HELD`` of the training rows, kept out of both fits, is the smaller one.

Defined results: null and empty texts get the score of a text without known terms; without
any label, or with one class only, every score is the share of class 1 (0.5 without rows);
repeated rows score alike; labels without a document and further columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stockline.llm.scan import ALNUM, U64, Words, mix
from stockline.llm.terms import TRAIN_ROWS, Sample, gather, score_texts, sigmoid, training_rows

COLUMNS = 4096
FREQUENT = 64         # terms that take part for their frequency alone
OTHERS = 4096         # further ones in the wider machine
HELD = 5              # one in so many training rows decides between the machines
FACTORS = 8
EPOCHS = 30
WIDE = {"rate": 0.2, "decay": 1e-3, "epochs": 20}  # the wider machine holds mostly noise, so its numbers are held small
BATCH = 64
HEADS = (5, 7)        # bytes of a word's beginning that are terms of their own
THRESHOLD = 0.3


def toxic_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offsets, ALNUM, lower=True)
    text = words.text_of()
    size = words.ends - words.starts
    parts = [(text, words.hashes())]
    for n in HEADS:
        longer = size > n
        parts.append((text[longer], mix(words.heads(n)[longer] + U64(n))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class FactorizationMachine:
    """``bias + sum w_i + sum over pairs <v_i, v_j>`` for the set of a text's columns."""

    def __init__(self, columns: int, seed: int = 5):
        self.bias = 0.0
        self.w = np.zeros(columns)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (columns, FACTORS))

    def margin(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(rows, self.w[cols], n)
        pairs = np.zeros(n)
        for f in range(FACTORS):
            x = self.v[cols, f]
            pairs += np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n)
        return self.bias + linear + pairs / 2

    def loss(self, sample: Sample) -> float:
        """The mean log loss over the sample."""
        n = len(sample.label)
        p = np.clip(sigmoid(self.margin(np.repeat(np.arange(n), np.diff(sample.at)), sample.cols, n)), 1e-9, 1 - 1e-9)
        return float(-np.log(np.where(sample.label == 1, p, 1 - p)).mean())

    def fit(self, sample: Sample, rate: float = 0.1, decay: float = 1e-4, seed: int = 9, epochs: int = EPOCHS) -> "FactorizationMachine":
        rng = np.random.default_rng(seed)
        share = sample.label.mean()
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(sample.label))
            for i in range(0, len(order), BATCH):
                mine = order[i : i + BATCH]
                sizes = sample.at[mine + 1] - sample.at[mine]
                rows = np.repeat(np.arange(len(mine)), sizes)
                cols = sample.cols[np.repeat(sample.at[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                sums = np.stack([np.bincount(rows, self.v[cols, f], len(mine)) for f in range(FACTORS)], axis=1)
                error = (sigmoid(self.margin(rows, cols, len(mine))) - sample.label[mine]) / len(mine)
                used, inverse = np.unique(cols, return_inverse=True)
                step_w = np.bincount(inverse, error[rows], len(used)) + decay * self.w[used]
                step_v = np.stack([np.bincount(inverse, error[rows] * (sums[rows, f] - self.v[cols, f]), len(used)) for f in range(FACTORS)], axis=1) + decay * self.v[used]
                gw[used] += step_w**2
                gv[used] += step_v**2
                self.w[used] -= rate * step_w / np.sqrt(gw[used])
                self.v[used] -= rate / 4 * step_v / np.sqrt(gv[used])
                step_b = error.sum()
                gb += step_b**2
                self.bias -= rate * step_b / np.sqrt(gb)
        return self


def learn(sample: Sample) -> tuple[FactorizationMachine, np.ndarray]:
    """The better one of both machines, and the columns of its buckets."""
    narrow = sample.only_telling()
    held = np.arange(len(sample.label)) % HELD == 0
    if not sample.telling.all() and 0 < sample.label[~held].mean() < 1 and held.any():
        wide = FactorizationMachine(len(sample.telling)).fit(sample.rows(~held), **WIDE)
        least = FactorizationMachine(len(narrow.telling)).fit(narrow.rows(~held)).loss(narrow.rows(held))
        if wide.loss(sample.rows(held)) < least:
            return FactorizationMachine(len(sample.telling)).fit(sample, **WIDE), sample.column_of
    return FactorizationMachine(len(narrow.telling)).fit(narrow), narrow.column_of


def score(docs: DataFrame, labels: DataFrame, fold, rows: int = TRAIN_ROWS, further: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the ``further`` columns and ``score`` of every row of ``docs``; labels are learnt only where ``fold`` holds."""
    sample = gather(docs, training_rows(labels, "toxic", fold, rows), toxic_terms, COLUMNS, FREQUENT, OTHERS)
    if len(sample.cols) == 0:
        share = float(sample.label.mean()) if len(sample.label) else 0.5
        return docs.select("doc_id", *further, F.lit(share).alias("score"))
    model, column_of = learn(sample)
    return score_texts(docs, toxic_terms, column_of, lambda r, c, n: sigmoid(model.margin(r, c, n)), *further)


def drop_toxic(docs: DataFrame, labels: DataFrame, fold, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows whose own text scores at or above the threshold; rows pass through the scoring, no text is shuffled."""
    names = {c: c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)}
    scored = score(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), labels, fold, rows, tuple(n for n in names.values() if n != "doc_id"))
    clean = scored.where(F.col("score") < THRESHOLD)
    return clean.select(*(F.col(n).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()))
