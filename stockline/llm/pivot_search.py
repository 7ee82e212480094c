"""Exact top-k inner products by pivot-table elimination.

Vectors are compared as whole numbers. Equal ones are one class with its ``k + 1`` smallest
ids (no other can be among the best), so copies of any number are looked at once. The
distances of each class to ``PIVOTS`` pivots, spread-out members of a bounded sample, are
its row of the pivot table; the nearest pivot is its cell, and a cell's rows are dealt to
shards of about ``SHARD_ROWS``. As ``2 <q, v> = |q|^2 + |v|^2 - d(q, v)^2`` and
``d(q, v) >= |d(q, p) - d(v, p)|`` for every pivot, the largest of these differences gives
an upper bound of the score.

Each query is first answered in its own shard; the score of its last place there is what
others must reach. It then goes to the cells whose bounds (smallest and largest distance
to each pivot) reach it. A shard's task takes candidates in the order of their bounds and
stops where the next bound is below the last place. Queries stream past a shard's rows, so
a task holds ``SHARD_ROWS`` rows and one batch of queries. Sample and cells are bounded;
which pivots they give changes the work, not the result.

Defined results: null vectors and those with a null or non-finite component take no part;
missing components of shorter vectors count as 0; components beyond the range of an int
count as its end, scores beyond the range of a long as its; a row without an id is a
candidate, after all others of its score; repeated rows are queries and candidates of
their own; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stockline.llm.store import keep

PIVOTS = 32
SAMPLE = 4_096          # classes that pivots are chosen from
SHARD_ROWS = 32_768
QUERY_BLOCK = 65_536    # queries that one task answers in one shard
BLOCK = 256             # candidates evaluated between two looks at the bound
_INT, _LONG = (1 << 31) - 1, (1 << 63) - 1


def whole_numbers(vector: str, scale: float) -> Column:
    return F.transform(F.col(vector), lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-_INT)), F.lit(_INT)).cast("int"))


def usable(vector: str) -> Column:
    def finite(x):
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    return F.col(vector).isNotNull() & F.forall(vector, finite)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The lists as rows, shorter ones filled with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def spread(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Members of the sample, each the farthest from those before it."""
    chosen = [0]
    near = np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
        chosen.append(int(near.argmax()))
    return sample[chosen]


def _slack(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray | float:
    """What distances kept as floats may be off by."""
    return 1e-6 * (a + b) + 1e-6


class Shard:
    """Rows of one shard, ready to be asked."""

    def __init__(self, classes: list[int], ids: list[list], x: np.ndarray, far: np.ndarray):
        self.classes, self.ids, self.x, self.far = classes, ids, x, far
        self.norm2 = (x**2).sum(axis=1)
        self.count = np.array([len(i) for i in ids])
        self.exact = float(np.sqrt(self.norm2.max(initial=0)))

    def scores(self, rows: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
        if q_norm * self.exact < 1 << 53:  # sums of whole numbers below that are exact
            return (self.x[rows] @ q).astype(np.int64)
        products = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in self.x[rows]]
        return np.array([max(-_LONG - 1, min(_LONG, p)) for p in products], dtype=np.int64)

    def best(self, q: np.ndarray, far: np.ndarray, least: float, k: int) -> list[tuple[int, int | None, int]]:
        """The best ``k`` ``(score, id, class)`` of at least ``least``."""
        norm2 = float((q**2).sum())
        low = np.abs(self.far - far).max(axis=1)
        low = np.maximum(low - _slack(low, np.maximum(self.far.max(axis=1), far.max())), 0)
        bound = (norm2 + self.norm2 - low**2) / 2
        bound += 1 + 1e-9 * (norm2 + self.norm2)
        rows = np.flatnonzero(bound >= least)
        rows = rows[np.argsort(-bound[rows], kind="stable")]
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for i in range(0, len(rows), BLOCK):
            block = rows[i : i + BLOCK]
            if bound[block[0]] < least:
                break
            block_scores = self.scores(block, q, norm2**0.5)
            found, scores = np.concatenate((found, block)), np.concatenate((scores, block_scores))
            order = np.argsort(-scores, kind="stable")
            found, scores = found[order], scores[order]
            filled = np.searchsorted(np.cumsum(self.count[found]), k)
            if filled < len(found):
                least = max(least, float(scores[filled]))
                stay = scores >= scores[filled]
                found, scores = found[stay], scores[stay]
        out = [(s, i, self.classes[f]) for f, s in zip(found.tolist(), scores.tolist()) if s >= least for i in self.ids[f]]
        return sorted(out, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]


def _answers(width: int, k: int):
    """Rows of a shard (``kind`` 0), then its queries (``kind`` 1): the best of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, shard = None, [], None
        for batch in batches:
            shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if shards[a] != now:
                    now, rows, shard = shards[a], [], None
                if kinds[a] == 0:
                    rows.append(part)
                    continue
                if rows:
                    table = pa.Table.from_batches(rows).combine_chunks()
                    far = table.column("far").combine_chunks()
                    shard = Shard(table.column("class_no").to_pylist(), table.column("ids").to_pylist(), matrix(table.column("v").combine_chunks(), width), matrix(far, len(far[0])))
                    rows = []
                if shard is None:
                    continue
                x, far = matrix(part.column(4), width), matrix(part.column(5), shard.far.shape[1])
                out = []
                for i, (name, least) in enumerate(zip(part.column(2).to_pylist(), part.column(6).to_pylist())):
                    out.extend((name, s, j, c == name) for s, j, c in shard.best(x[i], far[i], -np.inf if least is None else least, k))
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=["class_no", "score", "vec_id", "same"])

    return run


def _asked(rows: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """``class_no, score, vec_id``: what the shards answer, and whether the vector is the ``same`` as the query's."""
    none = F.lit(None)
    both = rows.select("shard", F.lit(0).alias("kind"), "class_no", "ids", "v", "far", none.cast("double").alias("least")).unionByName(
        queries.select("shard", F.lit(1).alias("kind"), "class_no", none.cast("array<long>").alias("ids"), "v", "far", "least"))
    return both.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_answers(width, k), "class_no long, score long, vec_id long, same boolean")


def _best(answers: DataFrame, k: int) -> DataFrame:
    """The best ``k`` answers of each query."""
    order = Window.partitionBy("class_no").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return answers.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _cells(table: DataFrame) -> list:
    """Rows, largest squared length and range of the distances to each pivot, per cell: as many rows as pivots at most."""

    def merge(t: pa.Table) -> pa.Table:
        far = np.array(t.column("low").to_pylist()), np.array(t.column("high").to_pylist())
        return pa.table({"cell": t.column("cell").slice(0, 1), "n": [sum(t.column("n").to_pylist())], "norm2": [max(t.column("norm2").to_pylist())],
                         "low": pa.array([far[0].min(axis=0).tolist()], pa.list_(pa.float64())), "high": pa.array([far[1].max(axis=0).tolist()], pa.list_(pa.float64()))})

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, norm2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            far = matrix(batch.column(2), len(batch.column(2)[0])) if batch.num_rows else None
            for c in np.unique(cell):
                mine = cell == c
                yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int64()), pa.array([int(mine.sum())], pa.int64()), pa.array([float(norm2[mine].max())]),
                                                  pa.array([far[mine].min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([far[mine].max(axis=0).tolist()], pa.list_(pa.float64()))],
                                                 names=["cell", "n", "norm2", "low", "high"])

    schema = "cell long, n long, norm2 double, low array<double>, high array<double>"
    return table.select("cell", "norm2", "far").mapInArrow(part, schema).groupBy("cell").applyInArrow(merge, schema).collect()


def top_inner_products(table: DataFrame, asks: Column, k: int = 5, name: str = "vec_id", vector: str = "embedding", scale: float = 256) -> DataFrame:
    """Per row of ``table`` where ``asks`` holds: ``query_id, rank, vec_id, score`` of the ``k`` other rows with the largest inner product."""
    base, _ = keep(table.where(usable(vector)).select(F.col(name).cast("long").alias("vec_id"), whole_numbers(vector, scale).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks")), "vectors")
    first = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    classes, _ = keep(base.select("v", "vec_id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).groupBy("v").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"]).alias("ids")).withColumn("class_no", F.monotonically_increasing_id()), "vector-classes")
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toPandas()["v"].tolist()
    width = max(1, classes.agg(F.max(F.size("v"))).first()[0] or 0)
    pivots = spread(matrix(pa.array(sample, pa.list_(pa.int32())), width), PIVOTS) if sample else np.zeros((1, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), width)
            far = distances(x, pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32)), pa.array(far.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far.argmin(axis=1).astype(np.int64)), pa.array((x**2).sum(axis=1)), lists],
                                             names=["class_no", "ids", "v", "cell", "norm2", "far"])

    placed, _ = keep(classes.select("class_no", "ids", "v").mapInArrow(place, "class_no long, ids array<long>, v array<int>, cell long, norm2 double, far array<float>"), "pivot-table")
    cells = _cells(placed)
    chunks = {r["cell"]: -(-r["n"] // SHARD_ROWS) for r in cells}
    chunk_of = F.element_at(F.create_map(*[F.lit(x) for pair in chunks.items() for x in pair]), F.col("cell")) if chunks else F.lit(1)
    sharded = placed.withColumn("shard", F.shiftleft("cell", 32) + F.pmod(F.xxhash64("class_no"), chunk_of))

    asking, _ = keep(base.where("asks").select("vec_id", "v").join(classes.select("v", "class_no"), "v").select("vec_id", "class_no"), "queries")
    queries, _ = keep(sharded.join(asking.select("class_no").distinct(), "class_no", "left_semi"), "query-classes")
    k1 = k + 1
    own, _ = keep(_best(_asked(sharded, queries.withColumn("least", F.lit(None).cast("double")), width, k1), k1), "own-answers")
    last = own.where(F.col("place") == k1).select("class_no", F.col("score").cast("double").alias("least"))

    # Cells are as many as pivots at most, so their bounds go with the task.
    numbers = np.array([r["cell"] for r in cells], dtype=np.int64)
    low, high, most = (np.array([r[c] for r in cells]) for c in ("low", "high", "norm2"))
    parts = np.array([chunks[c] for c in numbers.tolist()], dtype=np.int64)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                home, norm2, least = some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                far = matrix(some.column(3), low.shape[1])
                near = np.maximum(low[None] - far[:, None], far[:, None] - high[None]).max(axis=2)
                near = np.maximum(near - _slack(high.max(axis=1)[None], far.max(axis=1)[:, None]), 0)
                bound = (norm2[:, None] + most[None] - near**2) / 2 + 1 + 1e-9 * (norm2[:, None] + most[None])
                row, cell = np.nonzero(~(bound < least[:, None]))  # a query without a last place goes everywhere
                of = np.repeat(np.arange(len(row)), parts[cell])
                nth = np.arange(len(of)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
                shard, row = (numbers[cell][of] << 32) + nth, row[of]
                other = shard != home[row]
                columns = [some.column(j).take(pa.array(row[other])) for j in (4, 5, 3, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[other]), *columns], names=["shard", "class_no", "v", "far", "least"])

    routed = queries.join(last, "class_no", "left").select("shard", "norm2", "least", "far", "class_no", "v").mapInArrow(route, "shard long, class_no long, v array<int>, far array<float>, least double")
    if blocks > 1:
        # Every block of queries meets a copy of the shard.
        routed = routed.withColumn("shard", F.col("shard") * blocks + F.pmod(F.xxhash64("class_no"), F.lit(blocks)))
        copies = sharded.withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.col("shard") * blocks + i)))
    else:
        copies = sharded
    best = _best(own.drop("place").unionByName(_asked(copies, routed, width, k1)), k1).groupBy("class_no").agg(
        F.array_sort(F.collect_list(F.struct("place", "score", "vec_id", "same"))).alias("top"))
    # The query's own row goes; another row of its id and vector is like it.
    mine = F.get(F.filter("top", lambda x: x["same"] & (x["vec_id"] == F.col("vec_id"))), 0)
    others = F.slice(F.filter("top", lambda x: F.coalesce(x["place"] != mine["place"], F.lit(True))), 1, k)
    return asking.join(best, "class_no").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "found")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "found.vec_id", "found.score")
