import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, example, given, settings, strategies as st
from pyspark.sql import functions as F

from stockline.operators.admission import admit_all_or_nothing, admit_within_limit
from stockline.operators.allocation import allocate_fifo
from stockline.operators.groups import conflict_groups
from stockline.operators.numbering import assign_refs
from stockline.operators.prefix import running_totals
from stockline.operators.tiers import with_tiers

# A group above this many rows takes the range-partitioned form; 0 forces it.
FORMS = [10**9, 40, 0]


@pytest.fixture(scope="module")
def skewed():
    """Four of five rows belong to one key."""
    rng = random.Random(11)
    return [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.randint(-6, 7)) for i in range(400)]


@pytest.mark.parametrize("hot_rows", FORMS)
def test_running_totals_and_minimum(spark, skewed, hot_rows):
    expected, state = {}, {}
    for k, i, v in skewed:
        total, low = state.get(k, (0, 10**9))
        low = min(low, total + v)
        expected[i] = (total, low)
        state[k] = (total + v, low)
    df = spark.createDataFrame(skewed, "k int, i int, v int")
    out = running_totals(df, ["k"], [F.col("i")], {"s": F.col("v")}, {"low": F.col("s_incl")}, hot_rows=hot_rows)
    assert {r.i: (r.s, r.low) for r in out.collect()} == expected


def test_running_totals_over_whole_table_keeps_money_exact(spark):
    rows = [(i, Decimal(i) / 100) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "i int, m decimal(12,2)")
    got = {r.i: r.s for r in running_totals(df, [], [F.desc("i")], {"s": F.col("m")}).collect()}
    assert got == {i: sum((m for j, m in rows if j > i), Decimal(0)) for i, _ in rows}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(-9, 9)), min_size=1, max_size=30), st.integers(-12, 40))
@example([(1, 10), (1, -3), (1, 4)], 5)
@example([(1, 3), (2, 4), (1, 4), (1, 1), (2, 0)], 5)
@example([(1, 3), (1, 0)], -2)
@example([(1, -3), (1, 2), (1, -7), (1, 9), (1, -6)], -5)
def test_fifo_equals_fold(spark, demand, supply):
    left, expected = {}, []
    for key, need in demand:
        have = left.get(key, supply)
        got = need if have >= need else max(0, have)
        left[key] = have - got
        expected.append((got, have))
    df = spark.createDataFrame([(k, i, n, supply) for i, (k, n) in enumerate(demand)], "k int, i int, n int, s int")
    got = allocate_fifo(df, ["k"], [F.col("i")], "n", "s").orderBy("i").collect()
    assert [(r.qty_allocated, r._left) for r in got] == expected
    if all(need >= 0 for _, need in demand):
        got = allocate_fifo(df, ["k"], [F.col("i")], "n", "s", credits=False).orderBy("i").collect()
        assert [(r.qty_allocated, r._left) for r in got] == expected


@pytest.mark.parametrize("fold_rows,hot_rows", [(10**6, 10**6), (20, 10**6), (0, 30)])
def test_credit_admission_equals_fold(spark, fold_rows, hot_rows):
    rng = random.Random(5)
    limits = {1: 3000, 2: 250, 3: 0}
    asked = [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice([0, 1, 2, 60, 300, rng.randint(1, 900)]), rng.random() < 0.05)
             for i in range(250)]
    left, expected = dict(limits), {}
    for k, i, amount, free in asked:
        expected[i] = free or amount <= left[k]
        left[k] -= amount if expected[i] else 0
    df = spark.createDataFrame([(k, i, a, limits[k], f) for k, i, a, f in asked],
                               "k int, i int, a bigint, lim bigint, free boolean")
    out = admit_within_limit(df, "k", ["i"], "a", "lim", forced="free", fold_rows=fold_rows, hot_rows=hot_rows)
    got = [(r.i, r.accepted) for r in out.collect()]
    assert len(got) == len(asked) and dict(got) == expected


def test_credit_admission_takes_few_rounds_on_an_adversarial_order(spark):
    """Alternating tiny and just-too-large amounts must not need a round per request."""
    import stockline.operators.admission as admission

    asked = [(1, i, 1 if i % 2 == 0 else 1000 - i // 2) for i in range(120)]
    left, expected = 1000, {}
    for _, i, a in asked:
        expected[i] = a <= left
        left -= a if expected[i] else 0
    calls = []
    original = admission.running_totals
    admission.running_totals = lambda *a, **k: calls.append(1) or original(*a, **k)
    try:
        df = spark.createDataFrame([(k, i, a, 1000) for k, i, a in asked], "k int, i int, a bigint, lim bigint")
        got = {r.i: r.accepted for r in admit_within_limit(df, "k", ["i"], "a", "lim", fold_rows=0).collect()}
    finally:
        admission.running_totals = original
    assert got == expected
    assert len(calls) <= 11  # log2(1000) rounds and a last look


@pytest.mark.parametrize("block_rows", [1, 7, 100])
def test_credit_admission_in_blocks_equals_fold(spark, block_rows, monkeypatch):
    """Large keys with credits never meet the scan of whole keys; many blocks take few rounds."""
    import stockline.operators.admission as admission

    rng = random.Random(block_rows)
    limits = {1: 500, 2: 10_000, 3: -20, 4: 90}
    asked = [(rng.choice([1, 1, 1, 2, 3, 4]), i, rng.choice([-60, -5, 0, 3, 40, 200, 700]), rng.random() < 0.04) for i in range(300)]
    asked += [(k, 1000 + k, -1, False) for k in limits]
    left, expected = dict(limits), {}
    for k, i, amount, free in asked:
        expected[i] = free or amount <= left[k]
        left[k] -= amount if expected[i] else 0
    folded, rounds = [], []
    scan, follow = admission._fold, admission._chain
    monkeypatch.setattr(admission, "_fold", lambda requests, *a: folded.append(requests.count()) or scan(requests, *a))
    monkeypatch.setattr(admission, "_chain", lambda *a: rounds.append(1) or follow(*a))
    df = spark.createDataFrame([(k, i, a, limits[k], f, "x") for k, i, a, f in asked], "k int, i int, a bigint, lim bigint, free boolean, note string")
    out = admit_within_limit(df, "k", ["i"], "a", "lim", forced="free", fold_rows=0, block_rows=block_rows)
    got = [(r.i, r.accepted) for r in out.collect()]
    assert out.columns == [*df.columns, "accepted"] and len(got) == len(asked) and dict(got) == expected
    assert folded == [0] and len(rounds) <= 40


@pytest.mark.parametrize("fold_rows", [10**6, 0])
def test_credit_admission_with_credits_and_missing_numbers(spark, fold_rows):
    """Both forms refuse what has no amount or limit, and what is given back can be spent again."""
    rng = random.Random(3)
    limits = {1: 100, 2: 400, 3: None, 4: 50}
    asked = [(1, 0, -500, False), (1, 1, 550, False), (1, 2, 40, False)]
    asked += [(rng.choice([1, 2, 2, 3, 4]), i, rng.choice([None, -40, 0, 5, 90, 300]), rng.random() < 0.1) for i in range(3, 120)]
    asked = [(k, i, a if k != 4 or a is None else abs(a), f) for k, i, a, f in asked]
    left, expected = dict(limits), {}
    for k, i, amount, free in asked:
        known = amount is not None and left[k] is not None
        expected[i] = free or (known and amount <= left[k])
        if expected[i] and known:
            left[k] -= amount
    df = spark.createDataFrame([(k, i, a, limits[k], f) for k, i, a, f in asked], "k int, i int, a bigint, lim bigint, free boolean")
    got = {r.i: r.accepted for r in admit_within_limit(df, "k", ["i"], "a", "lim", forced="free", fold_rows=fold_rows).collect()}
    assert got == expected and got[0] and got[1] and got[2]


# Rounds alone, rounds with a scan of what is left, groups on the way, one scan.
@pytest.mark.parametrize("hot_rows, fold_rows", [(10**6, 0), (15, 0), (15, 12), (10**6, 10**6)])
@pytest.mark.parametrize("least", [1, -4])
def test_all_or_nothing_equals_fold(spark, hot_rows, fold_rows, least):
    rng = random.Random(8)
    stock = {p: rng.randint(4, 30) for p in range(5)} | {5: None}
    lines = [(t, rng.choice([0, 1, 2, 3, 4] * 4 + [5]), rng.randint(least, 6)) for t in range(60) for _ in range(rng.randint(1, 4))]
    lines = [(t, i, p, q) for i, (t, p, q) in enumerate(lines)] + [(60, 900, 1, None), (61, 901, 1, 0)]
    left, expected = dict(stock), {}
    for t in range(62):
        now, ok = dict(left), True
        for other, _, p, q in lines:
            if other == t:
                ok = ok and q is not None and now[p] is not None and now[p] >= q
                now[p] = now[p] - q if ok else now[p]
        expected[t] = ok
        left = now if ok else left
    df = spark.createDataFrame([(t, i, p, t * 10, q, stock[p]) for t, i, p, q in lines], "t int, i int, p int, o int, q int, s int")
    df = df.unionByName(df.limit(1).withColumn("t", F.lit(None).cast("int")))
    out = admit_all_or_nothing(df, "t", ["p"], ["o"], "q", "s", ["i"], hot_rows=hot_rows, fold_rows=fold_rows)
    assert {r.t: r.accepted for r in out.collect()} == expected


def _chains(chains, length):
    """Of each chain every request shares one unit with the next, so each outcome hangs on the one before."""
    return [(c * 1000 + n, c * 1000 + p, n) for c in range(chains) for n in range(length) for p in (n, n + 1)]


@pytest.mark.parametrize("chains, length, fold_rows", [(1, 500, 5000), (4, 20, 50)])
def test_all_or_nothing_takes_bounded_passes_on_chains(spark, monkeypatch, chains, length, fold_rows):
    from stockline.operators import admission

    rounds = []
    monkeypatch.setattr(admission, "running_totals", lambda *a, **k: rounds.append(1) or running_totals(*a, **k))
    df = spark.createDataFrame([(t, p, n, 1, 1, i) for i, (t, p, n) in enumerate(_chains(chains, length))],
                               "t int, p int, o int, q int, s int, i int")
    got = {r.t: r.accepted for r in admit_all_or_nothing(df, "t", ["p"], ["o"], "q", "s", ["i"], fold_rows=fold_rows).collect()}
    assert got == {t: n % 2 == 0 for t, _, n in _chains(chains, length)}
    assert len(rounds) <= 4


def test_only_large_groups_go_on_in_rounds(spark):
    """A chain too long for one scan beside short ones gives the same verdicts."""
    rows = _chains(2, 4) + [(t + 9000, p + 9000, n) for t, p, n in _chains(1, 7)]
    df = spark.createDataFrame([(t, p, n, 1, 1, i) for i, (t, p, n) in enumerate(rows)], "t int, p int, o int, q int, s int, i int")
    got = {r.t: r.accepted for r in admit_all_or_nothing(df, "t", ["p"], ["o"], "q", "s", ["i"], fold_rows=9).collect()}
    assert got == {t: n % 2 == 0 for t, _, n in rows}


def test_conflict_groups_equal_union_find(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 150), rng.choice(["x", "y", None]), rng.randint(0, 120)) for _ in range(190)]
    # A long chain, with names that do not grow along it, and one place that many requests touch.
    names = rng.sample(range(1000, 1200), 200)
    rows += [(name, "c", n + step) for n, name in enumerate(names) for step in (0, 1)] + [(i, "hot", 0) for i in range(2000, 2300)]
    rows += [(None, "c", 1), (None, "c", 150), (3000, None, None)]
    parent = {r: r for r, _, _ in rows if r is not None}

    def find(r):
        while parent[r] != r:
            r = parent[r]
        return r

    first = {}
    for r, a, b in rows:
        if r is not None and a is not None and b is not None:
            x, y = sorted((find(r), find(first.setdefault((a, b), r))))
            parent[y] = x
    df = spark.createDataFrame(rows, "r int, a string, b int")
    groups = {g.r: g._group for g in conflict_groups(df, "r", ["a", "b"]).collect()}
    assert groups == {r: find(r) for r in parent}
    assert conflict_groups(df.limit(0), "r", ["a", "b"]).collect() == []


def test_references_continue_per_year_and_grow_beyond_four_digits(spark):
    existing = spark.createDataFrame([("PO-2024-0007",), ("PO-2024-9998",), ("PO-2023-0050",), ("X-2024-1",)], "po_ref string")
    rows = spark.createDataFrame([(1, 2024), (2, 2023), (3, 2024), (4, 2025)], "id int, y int")
    out = assign_refs(rows, existing, "po_ref", "PO", F.col("y"), [F.col("id")])
    assert {r.id: r.po_ref for r in out.collect()} == {
        1: "PO-2024-9999", 2: "PO-2023-0051", 3: "PO-2024-10000", 4: "PO-2025-0001"}


def test_tier_lookups_differ_when_tiers_are_not_monotone(spark):
    tiers = spark.createDataFrame([("p", 10, 5), ("p", 25, 1), ("p", 5, 3), ("p", 5, 2)], "product_id string, min_qty int, discount_pct int")
    lines = spark.createDataFrame([("p", 4), ("p", 5), ("p", 24), ("p", 25), ("x", 9), (None, 9)], "product_id string, qty int")
    got = with_tiers(lines, tiers).orderBy(F.col("product_id").asc_nulls_last(), "qty").collect()
    assert [(r.qty, r.at_pct, r.best_pct) for r in got] == [
        (4, None, None), (5, 3, 3), (24, 5, 5), (25, 1, 5), (9, None, None), (9, None, None)]
