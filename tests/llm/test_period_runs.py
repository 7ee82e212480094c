import hashlib
import random
import zlib

import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st

from stockline.llm import period_runs
from stockline.llm.queries import op13_period_runs

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """All runs by comparing the words at every distance."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and not any(words[i : j + q - p] == words[i + p : j + q] for p in range(1, q)):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def of_slab(texts):
    return [(n, list(zip(s.tolist(), l.tolist(), p.tolist())), kept.decode()) for n, s, l, p, kept in period_runs._slab([t.encode() for t in texts])]


def expected(texts):
    out = []
    for t in texts:
        w = [x for x in t.translate({i: " " for i in range(9, 14)}).split(" ") if x]
        out.append((len(w), plain_runs(w), collapsed(w, plain_runs(w))))
    return out


_pieces = st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=7), st.integers(1, 12), st.integers(0, 6)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(_pieces, max_size=4))
def test_runs_equal_those_by_comparing_all_distances(texts):
    texts = [" ".join(x for p, times, cut in t for x in (p * times)[cut:]) for t in texts]
    assert of_slab(texts) == expected(texts)


def test_progressions_that_meet_keep_every_period():
    """Two stretches of period 2 that meet out of step: runs of several periods share the border."""
    texts = [" ".join("ba" * 15 + "ab" * 15), " ".join("b" + "a" * 40 + "b" + "a" * 37 + "b" + "a" * 40)]
    assert of_slab(texts) == expected(texts)
    assert len({q for _, _, q in of_slab(texts)[0][1]}) > 3


def test_defined_results(spark, frame):
    rnd = random.Random(2)
    docs = {0: None, 1: "", 2: " \n", 3: "x " * 11, 4: "x " * 12, 5: "é    " * 7, 6: "a b c d e f\n" * 2, 7: " ".join(rnd.choice("abc") for _ in range(4_000)),
            8: "one two three four five six seven eight nine ten eleven twelve"}
    rows = [*docs.items(), (4, docs[4]), (None, docs[4]), (None, "no run")]
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in period_runs.periodic_runs(frame(rows)).collect())
    assert got == sorted((str(i), *expected([t or ""])[0]) for i, t in rows)
    assert period_runs.periodic_runs(frame([])).collect() == []


def test_slabs_do_not_change_results(frame, spark, monkeypatch):
    rows = [(i, "a b c " * (i % 9) + "tail") for i in range(60)]
    whole = sorted(map(str, period_runs.periodic_runs(frame(rows)).collect()))
    parts = [of_slab([t])[0] for _, t in rows]
    assert whole == sorted(str(x) for x in period_runs.periodic_runs(frame(rows).coalesce(1)).collect())
    assert parts == of_slab([t for _, t in rows])


def test_query_on_whole_texts_equals_brute_force(spark):
    """All of sf0.001, its tenth of periodic texts included; texts of more than 1,500 words are left to the slab tests."""
    got = {r.doc_id: r for r in op13_period_runs(spark, SF).collect()}
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(table)
    compared = 0
    for row in table:
        w = (row["text"] or "").encode().split()
        h = zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 1_500:
            continue
        compared += 1
        runs, r = plain_runs(w), got[row["doc_id"]]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
    assert compared > 150
