"""Starting streams: append and update sinks on Parquet, and streams that run a batch job per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stockline.jobs.common import ledger_rows
from stockline.operators.prefix import HOT_ROWS, running_totals
from stockline.sources.snapshots import append_ledger
from stockline.sources.staging import stage
from stockline.streaming.stateful import order_stages, served_units, shards_for
from stockline.tables import Tables


def append_sink(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Exactly-once append to Parquet files."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start(path)
    )


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete folders ``<kind>=<number>`` below a path, in order."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in found if n.startswith(f"{kind}=") and fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.split("=")[1]) for n in done)


def _changes(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest complete snapshot (-1: none) and the change folders after it."""
    base = max(_numbers(spark, path, "base"), default=-1)
    return base, [n for n in _numbers(spark, path, "batch") if n > base]


def _newest(spark: SparkSession, path: str, keys: Sequence[str], base: int, batches: Sequence[int]) -> DataFrame:
    parts = [spark.read.parquet(f"{path}/batch={n}").withColumn("_batch", F.lit(n)) for n in batches]
    if base >= 0:
        parts.append(spark.read.parquet(f"{path}/base={base}").withColumn("_batch", F.lit(-1)))
    rows = reduce(DataFrame.unionByName, parts)
    values = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Merge snapshot and change folders into a new snapshot; the old ones go once it is complete.

    A run that is stopped before leaves a snapshot without its mark, which nobody reads and the next run
    replaces; one that is stopped while removing leaves folders that are older than the snapshot, which
    nobody reads either and the next run removes.
    """
    base, batches = _changes(spark, path)
    if batches:
        _newest(spark, path, keys, base, batches).write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")
        base = batches[-1]
    for kind, old in (("batch", lambda n: n <= base), ("base", lambda n: n < base)):
        for n in filter(old, _numbers(spark, path, kind)):
            fs, target = _files(spark, f"{path}/{kind}={n}")
            fs.delete(target, True)


def update_sink(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] | None = None, every: int = 16, **trigger
) -> StreamingQuery:
    """Keep every micro-batch's changed rows under ``batch=<id>``; a retried batch replaces its folder.

    With ``keys``, change folders are merged into a snapshot after each ``every`` micro-batches, so ``latest``
    reads one snapshot and ``every`` folders at most, however long the stream has run.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A batch that is repeated after it went into a snapshot would count as newer than it is.
        if keys and max(_numbers(spark, path, "base"), default=-1) >= batch_id:
            return
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if keys and len(_changes(spark, path)[1]) >= every:
            compact(spark, path, keys)

    return (
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current rows of an update sink: of each key the one written last."""
    base, batches = _changes(spark, path)
    return _newest(spark, path, keys, base, batches)


BUCKETS = 64


def _bucket(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def _queue(t: Tables, path: str, hot_rows: int) -> DataFrame:
    """Open backorders in serving order, written once: each line with the units of its stock row queued ``before`` it."""
    spark = t.orders.sparkSession
    fs, mark = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(mark):
        orders = t.orders.select(F.col("id").alias("order_id"), "order_ref", F.col("warehouse_code").alias("warehouse"), "created_at")
        lines = t.order_lines.where(
            F.col("fulfilment_status").isin("backordered", "partial") & (F.col("qty_backordered") > 0) & F.col("product_id").isNotNull()
        ).select(F.col("id").alias("line_id"), "order_id", "product_id", F.col("qty_backordered").cast("bigint").alias("need"))
        order = [F.col("created_at"), F.col("order_id"), F.col("line_id")]
        numbered = running_totals(
            lines.join(orders.where("warehouse IS NOT NULL"), "order_id"), ["product_id", "warehouse"], order, {"before": F.col("need")}, hot_rows=hot_rows)
        numbered.withColumn("bucket", _bucket("product_id", "warehouse")).hint("rebalance", F.col("bucket")).write.mode(
            "overwrite").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path)


def _shards(spark: SparkSession, path: str, keys: DataFrame) -> int:
    """The number of shards for a stream's state, found by its first start and kept."""
    fs, mark = _files(spark, f"{path}/_SUCCESS")
    if not fs.exists(mark):
        spark.range(1).select(F.lit(shards_for(keys.count())).alias("shards")).write.mode("overwrite").parquet(path)
    return spark.read.schema("shards int").parquet(path).first()[0]


def stream_backorder_allocation(
    ledger: DataFrame, t: Tables, root: str, checkpoint: str, hot_rows: int = HOT_ROWS, **trigger
) -> StreamingQuery:
    """Serve backorders whenever stock is received, from a stream of ledger rows.

    ``t`` is the state the stream starts from and is never rewritten. The queue of open lines is numbered
    once, in ``root/queue``: a line stands for the units from ``before`` to ``before + need`` of its stock
    row's queue. What the stream keeps per stock row is how far its queue is served (``served_units``), so a
    micro-batch reads the folders of those stock rows that it serves, and nothing of earlier micro-batches.
    A retried micro-batch replaces its own folders. Results: ``root/allocations`` and ledger rows in ``root/ledger``.
    """
    key = ["product_id", "warehouse"]
    queue = _queue(t, f"{root}/queue", hot_rows)
    opening = stage(t.warehouse_stock.join(queue.groupBy(*key).agg(F.sum("need").alias("queued")), key).select(
        *key, (F.col("qty_on_hand") - F.col("qty_reserved")).cast("bigint").alias("free"), "queued"), "opening-queues")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = f"{root}/served/batch={batch_id}"
        marked = batch.withColumn("bucket", _bucket(*key))
        marked.write.mode("overwrite").parquet(mine)
        served = spark.read.schema(marked.schema).parquet(mine)
        touched = [r[0] for r in served.select("bucket").distinct().collect()]  # at most BUCKETS
        lines = spark.read.parquet(f"{root}/queue").where(F.col("bucket").isin(touched)).drop("bucket")
        first, last = F.greatest("before", "served_from"), F.least(F.col("before") + F.col("need"), F.col("served_to"))
        given = lines.join(served.drop("bucket"), key).where(last > first).select(
            "line_id", *key, (last - first).cast("int").alias("qty"), "order_id", "order_ref", "at",
            (F.col("before") + F.col("need") - first).alias("open"))
        out = f"{root}/allocations/batch={batch_id}"
        given.write.mode("overwrite").parquet(out)
        done = spark.read.schema(given.schema).parquet(out)
        append_ledger(ledger_rows(
            done, "backorder_fulfilled", "order", F.col("order_id"),
            F.concat(F.lit("Auto-fulfilled "), F.col("qty").cast("string"), F.lit(" of "), F.col("open").cast("string"),
                     F.lit(" backordered units for "), "order_ref"),
            F.col("at"), F.col("warehouse"), F.col("product_id"), F.col("qty"),
        ), f"{root}/ledger", f"backorders-{batch_id}")

    return (
        served_units(ledger, opening, _shards(opening.sparkSession, f"{root}/shards", opening)).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_order_states(actions: DataFrame, t: Tables, root: str, checkpoint: str, delay: str = "0 seconds", **trigger) -> StreamingQuery:
    """Judge a stream of order actions (request_id, order_id, action, requested_at) and append the verdicts to ``root/moves``.

    Stages are kept as state (``order_stages``); refused rows have ``accepted`` false and an error code, and
    ``order_rejects`` reads them as a stream of their own. Actions on unknown orders are refused.
    """
    shards = _shards(actions.sparkSession, f"{root}/shards", t.orders)
    return append_sink(order_stages(actions, t, delay, shards), f"{root}/moves", checkpoint, **trigger)


def order_rejects(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The refused actions below ``root`` as a stream; ``schema`` is that of the verdicts."""
    return spark.readStream.schema(schema).parquet(f"{root}/moves").where("NOT accepted").select(
        F.col("request_id").cast("string").alias("request_id"), "error_code", F.col("order_id").cast("string").alias("detail"), "late")
