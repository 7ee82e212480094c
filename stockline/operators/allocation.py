"""First-come-first-served allocation of stock to demand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockline.operators.prefix import HOT_ROWS, running_totals


def allocate_fifo(
    demand: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    need: str,
    supply: str,
    out: str = "qty_allocated",
    hot_rows: int = HOT_ROWS,
    left: str = "_left",
    credits: bool = True,
) -> DataFrame:
    """Serve ``need`` in ``order`` from each key's ``supply`` until it runs out.

    A need that fits in what is left is served whole, a larger one gets what is left, if anything. A negative need
    (a credit) gives back. What is left before a row is the running total less its lowest value so far when that is
    negative, so no loop is required; it is returned as ``left``. A supply that starts below zero serves nothing
    until a credit is at least as large as what is missing, and only from there on needs count. A caller that has no
    negative needs says so with ``credits=False``; one running total is then enough.
    """
    served = F.when(F.col(left) >= F.col(need), F.col(need)).otherwise(F.greatest(F.lit(0), F.col(left))).cast("int")
    if not credits:
        before = running_totals(demand, keys, order, {"_before": F.col(need)}, hot_rows=hot_rows)
        rest = F.col(supply) - F.least(F.col("_before"), F.greatest(F.lit(0), F.col(supply)))
        return before.withColumn(left, rest.cast("bigint")).withColumn(out, served).drop("_before")
    owing = F.col(supply) < 0
    opened = running_totals(demand.where(owing), keys, order, {"_credits": (F.col(need) <= F.col(supply)).cast("int")}, hot_rows=hot_rows)
    counts = (F.col("_credits") > 0) | (F.col(need) <= F.col(supply))
    plain = demand.where(~owing).withColumns({"_credits": F.lit(1).cast("bigint"), "_counted": F.col(need).cast("bigint")})
    opened = opened.withColumn("_counted", F.when(counts, F.col(need)).otherwise(0).cast("bigint"))
    # Below zero the total is no floor before the first such credit has been booked.
    before = running_totals(
        plain.unionByName(opened), keys, order, {"_before": F.col("_counted")},
        floors={"_low": F.when(F.col("_credits") > 0, F.col(supply) - F.col("_before"))}, hot_rows=hot_rows,
    )
    rest = F.col(supply) - F.col("_before") - F.least(F.lit(0), F.coalesce("_low", F.lit(0)))
    return before.withColumn(left, rest.cast("bigint")).withColumn(out, served).drop("_before", "_low", "_counted", "_credits")
