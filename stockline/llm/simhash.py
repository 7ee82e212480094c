"""SimHash near-duplicates through a vantage-point tree.

Fingerprints are taken inside tasks, one text after another, and reduced to distinct
ones with their smallest document before anything is compared, so a group of copies of
any size is one fingerprint. The tree's upper levels are built from a bounded sample
(``SAMPLE`` fingerprints, whatever the input): each node holds a vantage point and the
median Hamming distance to it. A fingerprint's home shard is the leaf it falls into;
it also visits the leaves that its ball of radius ``RADIUS`` reaches, as the triangle
bound allows pairs only there. So every pair within the radius meets in the home shard
of either side: the search is exact, whatever the sample was.

A shard's task goes down the same way, with medians of its own points, until few are
left, and compares those directly. It returns links that span the shard's groups, never
all pairs of a group, and connected components join the shards' links.

Defined results: null and empty texts have fingerprint zero; an even split of a bit is
a zero; texts with fewer than three words are one shingle; repeated rows each come
back; rows with a null ``doc_id`` get their fingerprint and, if no other document shares
the component, a null component; an empty table gives an empty one; further columns
are ignored. ``drop_near_copies`` judges rows by ``doc_id`` and text together, so rows
of one id, or without any, share a fate only where their texts do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stockline.llm.components import connected_components
from stockline.llm.scan import U64
from stockline.llm.store import keep

SHINGLE = 3
SEED = 42
RADIUS = 2
SAMPLE = 65_536       # fingerprints that shape the tree
SHARD = 4_096         # home fingerprints a shard is meant to have
DIRECT = 512          # points compared directly inside a shard
_LANES = U64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; each byte lane counts eight bits of 255 rows at a time."""
    n = len(hashes)
    if n == 0:
        return 0
    pad = np.zeros(-n % 255, dtype=U64)
    rows = np.concatenate((hashes, pad)).reshape(-1, 255)
    out = 0
    for j in range(8):
        sums = ((rows >> U64(j)) & _LANES).sum(axis=1, dtype=U64)
        lanes = sums[:, None].view(np.uint8).sum(axis=0, dtype=np.int64)  # little-endian: byte b counts bit 8b + j
        for b in np.flatnonzero(lanes * 2 > n):
            out |= 1 << (8 * int(b) + j)
    return out


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum([len(w) + 1 for w in words], out=starts[1:])
        at, digest, seed = starts.tolist(), xxhash.xxh64_intdigest, SEED
        hashes = [digest(joined[i : j - 1], seed) for i, j in zip(at, at[SHINGLE:])]
    return majority(np.array(hashes, dtype=U64))


def fingerprints(docs: DataFrame, *further: str) -> DataFrame:
    """``doc_id``, the ``further`` columns (of longs) and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fps.view(np.int64))], names=["doc_id", *further, "fp"])

    names = ", ".join(f"{c} long" for c in ("doc_id", *further, "fp"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *further).mapInArrow(run, names)


def _split(points: np.ndarray, rng: np.random.Generator) -> tuple[int, int] | None:
    """A vantage point and a radius that halve the points best; None if nothing parts them."""
    best, score = None, 0.0
    for v in points[rng.integers(0, len(points), 4)]:
        d = np.bitwise_count(points ^ v)
        middle = int(np.median(d))
        for radius in (middle - 1, middle):
            inside = float((d <= radius).mean())
            balance = min(inside, 1 - inside)
            # Points near the border visit both sides.
            near = float(((d > radius - RADIUS) & (d <= radius + RADIUS)).mean())
            if balance > 0 and balance * (1.5 - near) > score:
                best, score = (int(v), radius), balance * (1.5 - near)
    return best


def build_tree(sample: np.ndarray, shards: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes ``(vantage point, radius, inner, outer)``; a negative child ``-1 - k`` is shard ``k``."""
    rng = np.random.default_rng(seed)
    nodes: list[list[int]] = []
    leaves = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal leaves
        split = _split(points, rng) if want > 1 and len(points) >= 8 else None
        if split is None:
            leaves += 1
            return -leaves
        me = len(nodes)
        nodes.append([split[0], split[1], 0, 0])
        inside = np.bitwise_count(points ^ U64(split[0])) <= split[1]
        share = max(1, min(want - 1, round(want * float(inside.mean()))))
        nodes[me][2] = grow(points[inside], share)
        nodes[me][3] = grow(points[~inside], want - share)
        return me

    if len(sample) == 0 or grow(sample, shards) < 0:
        return []
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, tree: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, shards and whether the shard is the row's home; each row visits all shards its ball reaches."""
    if not tree:
        n = len(points)
        return np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    todo = [(0, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while todo:
        at, rows, home = todo.pop()
        if len(rows) == 0:
            continue
        if at < 0:
            out.append((rows, -1 - at, home))
            continue
        vantage, radius, inner, outer = tree[at]
        d = np.bitwise_count(points[rows] ^ U64(vantage)).astype(np.int64)
        inside, go_in, go_out = d <= radius, d - RADIUS <= radius, d + RADIUS > radius
        todo.append((inner, rows[go_in], (home & inside)[go_in]))
        todo.append((outer, rows[go_out], (home & ~inside)[go_out]))
    return np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), s) for r, s, _ in out]), np.concatenate([h for _, _, h in out])


def _links(points: np.ndarray, home: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within the radius, one side at home; goes down the tree while points can be parted."""
    todo = [(np.arange(len(points)), home)]
    while todo:
        rows, own = todo.pop()
        mine = rows[own]
        if len(mine) == 0:
            continue
        split = _split(points[mine], rng) if len(mine) > DIRECT else None
        if split is not None:
            d = np.bitwise_count(points[rows] ^ U64(split[0])).astype(np.int64)
            inside, go_in, go_out = d <= split[1], d - RADIUS <= split[1], d + RADIUS > split[1]
            # A side that keeps nearly all points would only repeat the work.
            if max(go_in.mean(), go_out.mean()) < 0.9:
                todo.append((rows[go_in], (own & inside)[go_in]))
                todo.append((rows[go_out], (own & ~inside)[go_out]))
                continue
        step = max(1, (1 << 20) // len(rows))
        for i in range(0, len(mine), step):
            block = mine[i : i + step]
            a, b = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[rows][None, :]) <= RADIUS)
            a, b = block[a], rows[b]
            other = a != b
            if other.any():
                yield a[other], b[other]


def spanning_links(points: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the radius connects: one for each merge of two groups."""
    parent = list(range(len(points)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in _links(points, home, np.random.default_rng(11)):
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[rx] = ry
                out.append((x, y))
    return out


def _shard_task(table: pa.Table) -> pa.Table:
    points = table.column("fp").to_numpy().astype(np.int64).view(U64)
    pairs = spanning_links(points, table.column("home").to_numpy(zero_copy_only=False))
    fps = points.view(np.int64)
    a, b = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
    return pa.table({"a": pa.array(fps[a], pa.int64()), "b": pa.array(fps[b], pa.int64())})


def link_components(distinct: DataFrame, count: int) -> DataFrame:
    """``(id, component)`` over distinct fingerprints ``fp``, by value; singletons are left out."""
    share = min(1.0, 1.2 * SAMPLE / max(1, count))
    rows = distinct.select("fp").where(F.rand(5) <= share).limit(SAMPLE).toPandas()
    tree = build_tree(np.sort(rows["fp"].to_numpy(dtype=np.int64)).view(U64), -(-count // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            row, shard, home = route(fps.astype(np.int64).view(U64), tree)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(fps[row]), pa.array(home)], names=["shard", "fp", "home"])

    routed = distinct.select("fp").mapInArrow(run, "shard long, fp long, home boolean")
    links = routed.groupBy("shard").applyInArrow(_shard_task, "a long, b long")
    return connected_components(links, "a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, fingerprint, component_id``; documents of one component are linked by near fingerprints."""
    prints, _ = keep(fingerprints(docs), "fingerprints")
    distinct, _ = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct-fingerprints")
    groups = link_components(distinct, distinct.count())
    members = distinct.join(groups, distinct["fp"] == groups["id"], "left").select("fp", "smallest", F.coalesce("component", "fp").alias("component"))
    heads = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = members.join(heads, "component").select(F.col("fp").alias("own_fp"), "component_id")
    return prints.join(named, prints["fp"] == named["own_fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest ``doc_id``, of those without any that with the smallest text hash."""
    own_id = F.col("doc_id").cast("long")
    # Plain key columns, so that the join and the removal of repeated rows share one shuffle.
    own = docs.withColumns({"__none": own_id.isNull(), "__id": F.coalesce(own_id, F.lit(0)), "__print": F.xxhash64(F.col("text").cast("string"))})
    prints, _ = keep(fingerprints(own, "__print"), "fingerprints")
    distinct, _ = keep(prints.select("fp").distinct(), "distinct-fingerprints")
    groups = link_components(distinct, distinct.count())
    rows = prints.join(groups, prints["fp"] == groups["id"], "left").select("doc_id", "__print", F.coalesce("component", "fp").alias("component"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__print")).alias("first"))
    stays = first.select(F.col("first.none").alias("__none"), F.coalesce("first.doc_id", F.lit(0)).alias("__id"), "first.__print").distinct()
    return own.join(stays, stays.columns, "left_semi").dropDuplicates(stays.columns).select(docs.columns)
