import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from stockline.llm import components, exact_dedup, simhash, substring_dedup
from stockline.llm.components import connected_components
from tests.llm import brute


def test_components_are_those_of_the_graph(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3)]
    group = {v: v for e in edges for v in e if v is not None}
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                group[a] = group[b] = min(group[a], group[b])
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "s long, t long"), "s", "t").collect()}
    assert got == {v: c for v, c in group.items() if v != c}
    assert connected_components(spark.createDataFrame([], "s long, t long"), "s", "t").count() == 0


def test_the_join_at_a_hub_is_split(spark, tmp_path):
    """Half of all edges at one vertex: the join of edges and written minima has skewed partitions split."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.shuffle.partitions": "12", "spark.sql.files.maxPartitionBytes": "64KB"}
    old = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plain = spark.range(120_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("a"), (F.col("id") + 1_000_000).alias("b"))
        plain.repartition(8).write.parquet(f"{tmp_path}/edges")
        edges = spark.read.parquet(f"{tmp_path}/edges")
        components.minima(edges).write.parquet(f"{tmp_path}/minima")
        joined = components.towards_minimum(edges, spark.read.parquet(f"{tmp_path}/minima"))
        assert joined.where("m <> a").count() == 0
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_near_duplicates_equal_brute_force(frame, corpus):
    rows = simhash.near_duplicates(frame(corpus.items())).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == brute.near_groups(corpus)
    assert len(rows) == len(corpus)


def test_near_duplicates_of_repeated_null_and_no_rows(frame):
    got = [tuple(r) for r in simhash.near_duplicates(frame([(3, "a b c"), (3, "a b c"), (None, "a b c d"), (7, None)])).collect()]
    assert len(got) == 4 and sorted(g[2] for g in got if g[0] is not None) == [3, 3, 7]
    assert simhash.near_duplicates(frame([])).count() == 0
    assert simhash.drop_near_copies(frame([(3, "a b c"), (3, "a b c"), (4, "a b c"), (7, None)])).count() == 2


def test_near_copies_are_dropped_by_row(frame):
    other, near = "entirely other text", "z y x w"
    rows = [(None, "x"), (None, other), (None, other), (3, near), (3, "p q r s"), (None, near), (9, "p q r s"), (5, None)]
    left = simhash.drop_near_copies(frame(rows))
    assert left.columns == frame([]).columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [(None, "x"), (None, other), (3, near), (3, "p q r s"), (5, None)]))


@pytest.mark.parametrize("shards", [1, 5, 40])
def test_every_close_pair_meets_in_a_home_shard(shards):
    rng = np.random.default_rng(shards)
    far = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = far[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    cluster = far[0] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    points = np.unique(np.concatenate((far, near, cluster)))
    tree = simhash.build_tree(rng.permutation(points)[:600], shards)
    row, shard, home = simhash.route(points, tree)
    assert np.bincount(row[home], minlength=len(points)).tolist() == [1] * len(points)
    found = set()
    for s in np.unique(shard):
        mine = row[shard == s]
        for a, b in simhash._links(points[mine], home[shard == s], np.random.default_rng(2)):
            found |= {(min(x, y), max(x, y)) for x, y in zip(mine[a].tolist(), mine[b].tolist())}
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= simhash.RADIUS)
    assert found == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def test_majority_counts_every_bit():
    for n in (1, 2, 254, 255, 256, 600):
        h = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        assert simhash.majority(h) == sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h) * 2 > n)


def test_substring_removal_equals_brute_force(frame, corpus, monkeypatch):
    want = brute.without_repeats(corpus)
    for blocks, slab in ((1, 1 << 30), (7, 2000)):
        monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 400_000 // blocks)
        monkeypatch.setattr(substring_dedup, "SLAB", slab)
        rows = substring_dedup.remove_repeats(frame(corpus.items())).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
        assert all(brute.sha(r["text"]) == r["kept_sha256"] for r in rows)


def test_a_phrase_in_ever_new_surroundings_gets_several_blocks(frame, monkeypatch):
    rnd = random.Random(4)

    def other(n):
        return " ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(n))

    phrase, shared = "all rights of this work remain with those who made it", other(15)
    docs = {i: f"{other(15)} {phrase} {other(15) if i % 3 else shared}" for i in range(240)}
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1.0)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2000)
    frequent = substring_dedup.frequent_seeds(frame(docs.items()).select("doc_id", "text"), 30)
    assert len(frequent[0]) and frequent[1].max() > 1 and (np.diff(frequent[0].astype(float)) > 0).all()
    seeds = np.full(5000, frequent[0][0])
    windows = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    blocks = substring_dedup._block_of(seeds, windows, 30, frequent)
    assert len(np.unique(blocks)) == frequent[1][0] and (blocks == substring_dedup._block_of(seeds, windows, 30, frequent)).all()
    rows = substring_dedup.remove_repeats(frame(docs.items())).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute.without_repeats(docs)


def test_substring_removal_of_odd_tables(frame):
    assert substring_dedup.remove_repeats(frame([])).count() == 0
    text = " ".join(map(str, range(30)))
    rows = substring_dedup.remove_repeats(frame([(None, text), (1, text), (2, text), (3, None)])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {None: 0, 1: 0, 2: 30, 3: 0}


@pytest.mark.parametrize("slab", [1 << 30, 10])
def test_substring_removal_of_repeated_ids(frame, monkeypatch, slab):
    monkeypatch.setattr(substring_dedup, "SLAB", slab)
    text, other = " ".join(map(str, range(30))), " ".join(f"o{i}" for i in range(40))
    rows = substring_dedup.remove_repeats(frame([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in rows) == [(1, 0, text), (1, 0, text), (2, 30, "")]
    # Of one id with different texts, each row is cut at its own places; the same document's earlier start stays.
    rows = substring_dedup.remove_repeats(frame([(1, text), (5, text), (5, other), (5, "a b " + other), (6, other)])).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in rows) == [(1, 0, text), (5, 0, other), (5, 30, ""), (5, 40, "a b"), (6, 40, "")]
    # An equal place of another row of the id is not an earlier one.
    rows = substring_dedup.remove_repeats(frame([(7, text + " tail"), (7, text + " end"), (8, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in rows) == [(7, 0, text + " end"), (7, 0, text + " tail"), (8, 30, "")]


def test_exact_groups_equal_brute_force(frame, corpus):
    for files in (1, 256):  # several micro-batches, or one
        rows = exact_dedup.exact_groups(frame(corpus.items()), files).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows} == brute.exact(corpus)


def test_exact_dedup_of_odd_tables(frame):
    assert exact_dedup.exact_groups(frame([])).count() == 0
    rows = exact_dedup.exact_groups(frame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "x")])).collect()
    assert sum(r["kept"] for r in rows) == 2 and {r["group_size"] for r in rows} == {1, 3}
    left = exact_dedup.drop_copies(frame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "x"), (5, None)]))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [(1, "a b"), (None, "x"), (5, None)]))
    assert left.columns == ["doc_id", "text", "label", "n", "fp", "digest", "kept"]
    left = exact_dedup.drop_copies(frame([(1, "a b"), (1, "a   b   "), (1, "ab"), (2, "ab"), (None, "c d"), (None, "c  d")]))
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [(1, "a   b   "), (None, "c  d")]))


def test_texts_that_share_a_digest_are_told_apart(frame, monkeypatch):
    """A digest of the first character only: groups are split by their full texts, without an id too."""
    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.sha2(F.substring(norm, 1, 1).cast("binary"), 256))
    rows = [(1, "ax"), (2, "a x"), (3, "ay"), (None, "ay"), (None, "a  z"), (4, "b"), (4, "b c"), (4, "bc"), (5, "bc "), (6, "c")]
    got = exact_dedup.exact_groups(frame(rows)).collect()
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got))) == sorted(map(str, [
        (1, 2, 2, False), (2, 2, 2, True), (3, None, 2, False), (None, None, 2, True), (None, None, 1, True), (4, 4, 1, True),
        (4, 4, 3, True), (4, 4, 3, False), (5, 4, 3, False), (6, 6, 1, True)]))
