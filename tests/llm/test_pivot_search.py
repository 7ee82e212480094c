import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockline.llm import pivot_search

LONG = (1 << 63) - 1


def plain_top(rows, asks, k=5):
    """[(query_id, rank, vec_id, score)] by comparing each query with every row."""
    whole = [(i, [max(-pivot_search._INT, min(pivot_search._INT, math.floor(256 * x))) for x in v])
             for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(whole):
        if q is None or not asks(q):
            continue
        scores = [(max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(a, b)))), i) for m, (i, b) in enumerate(whole) if m != n]
        best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out.extend((q, r + 1, i, s) for r, (s, i) in enumerate(best))
    return sorted(out, key=str)


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, shard int, class_no string").repartition(3)


@pytest.fixture(scope="module")
def vectors():
    """Clusters, copies of one vector, ties, ragged, zero and unusable vectors, repeated and missing ids."""
    rng = np.random.default_rng(6)
    heads = rng.normal(0, 0.3, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in heads[i % 6] + rng.normal(0, 0.05, 8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 340)]
    rows += [(400, []), (401, [0.0] * 8), (402, [1.0, 0.25]), (410, [float("nan")] * 8), (420, None), (430, [1.0, None]), (440, [float("inf")])]
    rows += [(450, [-0.75] * 8), (450, [-0.75] * 8), (450, [0.125] * 8), (10, rows[10][1]), (None, [0.5] * 8), (None, [-0.75] * 8), (460, rows[20][1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_top_equals_comparing_every_row(spark, vectors, monkeypatch, small):
    if small:
        monkeypatch.setattr(pivot_search, "SHARD_ROWS", 20)
        monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 7)
        monkeypatch.setattr(pivot_search, "PIVOTS", 4)
    got = pivot_search.top_inner_products(frame_of(spark, vectors), F.col("vec_id") % 10 == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_top(vectors, lambda q: q % 10 == 0)


def test_few_rows_and_none(spark):
    def ask(rows):
        return sorted((tuple(r) for r in pivot_search.top_inner_products(frame_of(spark, rows), F.col("vec_id") % 50 == 0).collect()), key=str)

    assert ask([]) == []
    assert ask([(1, [1.0])]) == []
    assert ask([(0, [1.0]), (1, [2.0]), (2, [-1.0])]) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]


def test_components_of_any_size(spark):
    rows = [(0, [1e30, 3.0]), (1, [1e30, 3.0]), (2, [1e30, -1.0]), (3, [-1e30, 1e30]), (50, [4_000_000.0, 0.5]), (51, [4_000_000.0, 0.75])]
    got = pivot_search.top_inner_products(frame_of(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_top(rows, lambda q: q % 50 == 0)


def test_a_shard_stops_by_its_bounds():
    """Rows whose bound is below the last place are not evaluated."""
    rng = np.random.default_rng(1)
    heads = rng.normal(0, 60, (40, 16))
    x = np.floor(heads[np.arange(4_000) % 40] + rng.normal(0, 2, (4_000, 16)))
    pivots = pivot_search.spread(x, 16)
    far = pivot_search.distances(x, pivots)
    shard = pivot_search.Shard(list(range(4_000)), [[i] for i in range(4_000)], x, far.astype(np.float32))
    seen, plain = [], shard.scores
    shard.scores = lambda rows, *more: seen.extend(rows.tolist()) or plain(rows, *more)
    for q in range(0, 4_000, 400):
        scores = (x @ x[q]).astype(np.int64)
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()))[:6]
        assert [(-s, i) for s, i, _ in shard.best(x[q], far[q].astype(np.float32), -np.inf, 6)] == want
    assert len(seen) < 4_000 * 10 / 2
