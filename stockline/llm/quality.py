"""Quality scores by naive Bayes support vectors.

Each term's indicator is scaled by the logarithm of its class ratio, ``log(p / |p|) -
log(q / |q|)`` with add-one counts, and the scaled vector is brought to length one. A linear
hinge-loss model is fitted to these by dual coordinate descent, one example at a time.
A logistic curve, fitted on examples kept apart, turns its margins into scores.

Terms are words, pairs of words, word endings, the shape of words, and how often a text
repeats its words, as bands of their own.

Defined results: null and empty texts are texts without any term but their bands; without
any label, or with one class only, every score is the share of class 1 (0.5 without rows);
repeated rows score alike; labels without a document and further columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stockline.llm.scan import DARK, U64, Words, mix
from stockline.llm.terms import TRAIN_ROWS, Sample, gather, score_texts, sigmoid, training_rows

COLUMNS = 1 << 15
COST = 1.0
PASSES = 15


def _band(kind: int, share: np.ndarray) -> np.ndarray:
    """A term for each tenth that a share lies in."""
    return mix(np.minimum((share * 10).astype(np.int64), 9).astype(U64) + U64(1000 * kind))


def quality_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, offsets, DARK)
    text, h, n = words.text_of(), words.hashes(), words.counts()
    texts = np.arange(len(n))
    head = data[words.starts] if len(words) else np.zeros(0, np.uint8)
    tail = data[words.ends - 1] if len(words) else np.zeros(0, np.uint8)
    upper = (head >= 65) & (head <= 90) & (words.ends - words.starts > 1) & (data[np.minimum(words.starts + 1, max(0, len(data) - 1))] - np.uint8(65) < 26) if len(words) else np.zeros(0, bool)
    letter = (tail >= 128) | ((tail | 32) - np.uint8(97) < 26)
    same = (text[1:] == text[:-1]) if len(words) else np.zeros(0, bool)
    pairs, repeat = mix(h[:-1] * U64(3) + h[1:])[same], (same & (h[1:] == h[:-1]))
    per = np.maximum(n, 1)
    distinct = np.unique(np.stack((text.astype(U64), h)), axis=1)[0] if len(words) else np.zeros(0, U64)
    bands = [
        _band(1, np.bincount(distinct.astype(np.int64), minlength=len(n)) / per),
        _band(2, np.bincount(text[1:][repeat], minlength=len(n)) / per if len(words) else np.zeros(len(n))),
        _band(3, np.bincount(text, upper, len(n)) / per),
        _band(4, np.bincount(text, ~letter, len(n)) / per),
        mix(np.log2(per).astype(U64) + U64(5000)),
    ]
    return (np.concatenate((text, text, text[1:][same] if len(words) else text, *[texts] * len(bands))),
            np.concatenate((h, mix(words.tails(3) + U64(3)), pairs, *bands)))


class NaiveBayesSvm:
    def __init__(self, sample: Sample):
        p, q = sample.positives + 1.0, sample.negatives + 1.0
        self.ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        self.w = np.zeros(len(p))
        self.bias = 0.0
        self.slope, self.shift = 1.0, 0.0

    def margin(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[cols]
        size = np.sqrt(np.bincount(rows, r * r, n))
        return np.bincount(rows, r * self.w[cols], n) / np.maximum(size, 1e-9) + self.bias

    def fit(self, sample: Sample, seed: int = 13) -> "NaiveBayesSvm":
        """Dual coordinate descent on four fifths of the rows, the logistic curve on the rest."""
        n = len(sample.label)
        cut = max(1, n * 4 // 5)
        y = sample.label * 2.0 - 1.0
        # Each class bears half of the cost.
        cost = COST * n / 2 / np.maximum(np.where(y > 0, (y > 0).sum(), (y < 0).sum()), 1)
        rows = []
        for i in range(n):
            cols = sample.cols[sample.at[i] : sample.at[i + 1]]
            x = self.ratio[cols]
            rows.append((cols, x / max(1e-9, float(np.sqrt(x @ x)))))
        alpha, rng = np.zeros(n), np.random.default_rng(seed)
        for _ in range(PASSES):
            for i in rng.permutation(cut).tolist():
                cols, x = rows[i]
                gradient = y[i] * (x @ self.w[cols] + self.bias) - 1
                new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # |x|^2 + 1 for the bias is 2
                if new != alpha[i]:
                    step = (new - alpha[i]) * y[i]
                    self.w[cols] += step * x
                    self.bias += step
                    alpha[i] = new
        self._calibrate(np.array([x @ self.w[c] + self.bias for c, x in rows[cut:] or rows]), sample.label[cut:] if cut < n else sample.label)
        return self

    def _calibrate(self, m: np.ndarray, label: np.ndarray) -> None:
        """Newton steps for the logistic curve, with targets drawn in a little."""
        ones = label.sum()
        target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
        for _ in range(50):
            p = sigmoid(self.slope * m + self.shift)
            g = np.array([((p - target) * m).sum() + 1e-3 * self.slope, (p - target).sum()])
            s = p * (1 - p)
            hess = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
            self.slope, self.shift = np.array([self.slope, self.shift]) - np.linalg.solve(hess, g)

    def score(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.slope * self.margin(rows, cols, n) + self.shift)


def score(docs: DataFrame, labels: DataFrame, fold, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``; labels are learnt only where ``fold`` holds."""
    sample = gather(docs, training_rows(labels, "quality", fold, rows), quality_terms, COLUMNS)
    if len(sample.cols) == 0:
        share = float(sample.label.mean()) if len(sample.label) else 0.5
        return docs.select("doc_id", F.lit(share).alias("score"))
    model = NaiveBayesSvm(sample).fit(sample)
    return score_texts(docs, quality_terms, sample.column_of, model.score)
