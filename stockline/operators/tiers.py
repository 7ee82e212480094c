"""Quantity-break lookups: the as-of join of an ordered quantity with a product's price tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def tier_intervals(price_tiers: DataFrame) -> DataFrame:
    """One row per product and quantity range: the discount of its break, and the best one reached so far.

    The ranges of a product do not overlap, so a line meets at most one of them.
    The window sees a product's distinct breaks, never order lines.
    """
    breaks = price_tiers.groupBy("product_id", "min_qty").agg(F.max("discount_pct").alias("at_pct"))
    ascending = Window.partitionBy("product_id").orderBy("min_qty")
    return breaks.select(
        "product_id", F.col("min_qty").alias("_from_qty"), F.lead("min_qty").over(ascending).alias("_below_qty"),
        "at_pct", F.max("at_pct").over(ascending).alias("best_pct"),
    )


def with_tiers(lines: DataFrame, price_tiers: DataFrame) -> DataFrame:
    """Add ``at_pct`` (greatest break not above ``qty``) and ``best_pct`` (largest discount of those reached).

    An equi-join on the product whose condition picks the one fitting range; NULL if no break is reached.
    """
    ranges = tier_intervals(price_tiers)
    fits = (
        (lines["product_id"] == ranges["product_id"]) & (lines["qty"] >= ranges["_from_qty"])
        & (ranges["_below_qty"].isNull() | (lines["qty"] < ranges["_below_qty"]))
    )
    return lines.join(ranges, fits, "left").select(*[lines[c] for c in lines.columns], "at_pct", "best_pct")
