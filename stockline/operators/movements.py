"""Apply quantity changes to stock and report the balance after each one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockline.operators.joins import growing
from stockline.operators.prefix import HOT_ROWS, running_totals

KEY = ["product_id", "warehouse"]

# Fixed value: reorder point of a stock row created by the first receipt.
NEW_ROW_REORDER_POINT = 5


def apply_deltas(stock: DataFrame, moves: DataFrame, qty: str = "qty_change", target: str = "qty_on_hand") -> DataFrame:
    """Stock with the sum of all changes added; changes of unknown rows have no effect."""
    deltas = moves.groupBy(*KEY).agg(F.sum(qty).alias("_delta"))
    changed = (F.col(target) + F.coalesce("_delta", F.lit(0))).cast("int").alias(target)
    return stock.join(deltas, KEY, "left").select(*[changed if c == target else F.col(c) for c in stock.columns])


def create_missing(stock: DataFrame, moves: DataFrame, qty: str = "qty_change") -> DataFrame:
    """New stock rows for changes that found none."""
    kinds = dict(stock.dtypes)
    new = moves.groupBy(*KEY).agg(F.sum(qty).cast("int").alias("qty_on_hand")).join(
        stock.select(*KEY), KEY, "left_anti"
    )
    values = {
        "id": F.concat_ws("-", *[F.col(k).cast("string") for k in KEY]).try_cast(kinds["id"]),
        "product_id": F.col("product_id"), "warehouse": F.col("warehouse"), "qty_on_hand": F.col("qty_on_hand"),
        "qty_reserved": F.lit(0), "reorder_point": F.lit(NEW_ROW_REORDER_POINT),
    }
    return new.select(*[values.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def balances(
    stock: DataFrame, moves: DataFrame, order: Sequence[Column], absent: Column, qty: str = "qty_change",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``balance_after`` to every change; ``absent`` is used where there is no stock row."""
    opening = stock.select(*KEY, F.col("qty_on_hand").alias("_opening"))
    joined = running_totals(moves, KEY, order, {"_before": F.col(qty)}, hot_rows=hot_rows).join(growing(opening), KEY, "left")
    after = F.col("_opening") + F.col("_before") + F.col(qty)
    return joined.withColumn(
        "balance_after", F.when(F.col("_opening").isNotNull(), after).otherwise(absent).cast("int")
    ).drop("_opening", "_before")
