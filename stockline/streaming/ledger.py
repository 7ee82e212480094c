"""Live views over the stock ledger, replacing the polled screens of the reference.

Each function maps a streaming DataFrame of ledger rows to another streaming
DataFrame; ``sinks`` starts it. State is keyed by product and warehouse, rows are
summed before the shuffle, and every stateful view is bounded by a watermark or
by the number of stock rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockline.plans.ledger import category
from stockline.tables import SCHEMAS, Tables

KEY = ["warehouse_code", "product_id"]


def read_ledger_stream(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Ledger folder as a file stream; new files are new rows."""
    return spark.readStream.schema(schema or SCHEMAS["audit_log"]).options(**options).parquet(path)


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def with_event_time(ledger: DataFrame, delay: str, column: str = "created_at") -> DataFrame:
    """Add ``_at`` with a watermark: the wall-clock time read as UTC, since watermarks need an instant.

    The session time zone plays no part, so windows start at wall-clock midnight everywhere.
    """
    micros = F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(column))
    return ledger.withColumn("_at", F.timestamp_micros(micros)).withWatermark("_at", delay)


def wall_time(instant: Column) -> Column:
    """Back from the instant of ``with_event_time`` to wall-clock time."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


def stream_dedup_ledger(ledger: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated ledger ids that arrive within ``delay`` of each other."""
    return with_event_time(ledger, delay).dropDuplicatesWithinWatermark(["id"]).drop("_at")


def stream_stock_balance(ledger: DataFrame) -> DataFrame:
    """Net quantity per warehouse and product; run in update mode."""
    return ledger.where(F.col("product_id").isNotNull()).groupBy(*KEY).agg(
        F.sum("qty_change").alias("balance"), F.count("*").alias("movements"), F.max("created_at").alias("last_at")
    )


def stream_movements_by_day(ledger: DataFrame, delay: str = "2 days") -> DataFrame:
    """Rows and net quantity per day, warehouse and activity category."""
    return (
        with_event_time(ledger, delay)
        .groupBy(F.window("_at", "1 day").alias("w"), "warehouse_code", category().alias("category"))
        .agg(F.count("*").alias("entries"), F.coalesce(F.sum("qty_change"), F.lit(0)).alias("net_qty"))
        .select(F.to_date(wall_time(F.col("w.start"))).alias("day"), "warehouse_code", "category", "entries", "net_qty")
    )


def stream_burn_rate(ledger: DataFrame, delay: str = "1 day", days: int = 30) -> DataFrame:
    """Units shipped per day over a sliding window that moves by a day; run in append mode.

    Rows are summed per day first, so the sliding window multiplies daily sums
    and not ledger rows.
    """
    daily = (
        with_event_time(ledger.where(F.col("action") == "stock_shipped"), delay)
        .groupBy(F.window("_at", "1 day").alias("w"), *KEY)
        .agg(F.sum(-F.col("qty_change")).alias("units"))
        .select(F.window_time("w").alias("at"), *KEY, "units")
    )
    return (
        daily.groupBy(F.window("at", f"{days} days", "1 day").alias("w"), *KEY)
        .agg(F.sum("units").alias("units"))
        .select(
            wall_time(F.col("w.start")).alias("from_at"), wall_time(F.col("w.end")).alias("to_at"), *KEY, "units",
            F.round(F.col("units").cast("decimal(20,6)") / days, 4).cast("decimal(18,4)").alias("daily_rate"),
        )
    )


def with_reorder_points(movements: DataFrame, t: Tables) -> DataFrame:
    """Join opening stock and reorder point to a stream (stream-static, equi-join)."""
    points = t.warehouse_stock.select(
        "product_id", F.col("warehouse").alias("warehouse_code"), "reorder_point",
        F.col("qty_on_hand").alias("opening"),
    )
    return movements.join(points, KEY)
