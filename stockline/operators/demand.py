"""Demand rates per product and warehouse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockline.functions import days_between
from stockline.tables import Tables


def demand_rates(t: Tables, asof: Column) -> DataFrame:
    """Units ordered per day since the first order, per product and order warehouse.

    Every order counts whatever its status; the span is at least one day.
    """
    orders = t.orders.select(F.col("id").alias("order_id"), F.col("warehouse_code").alias("warehouse"), "created_at")
    lines = t.order_lines.select("order_id", "product_id", "qty_ordered")
    totals = lines.join(orders, "order_id").groupBy("product_id", "warehouse").agg(
        F.sum("qty_ordered").alias("units"), F.min("created_at").alias("first_at")
    )
    span = F.greatest(days_between(asof, F.col("first_at")), F.lit(1.0))
    return totals.select(
        "product_id", "warehouse", F.col("units").alias("units_ordered"),
        (F.col("units").cast("double") / span).alias("daily_rate"),
    )


def days_left(on_hand: str = "qty_on_hand", rate: str = "daily_rate") -> Column:
    """Days of cover; NULL without demand."""
    return F.when(F.col(rate) > 0, F.col(on_hand).cast("double") / F.col(rate))


def one_decimal(c: Column) -> Column:
    return F.round(c.cast("decimal(20,6)"), 1).cast("decimal(18,1)")
