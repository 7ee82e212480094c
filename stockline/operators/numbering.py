"""Document references: PREFIX-YYYY-NNNN, numbered per year after the highest in use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockline.operators.prefix import running_totals


def pad4(number: Column) -> Column:
    """At least four digits; longer numbers are kept whole."""
    text = number.cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


def last_numbers(existing: DataFrame, ref_column: str, prefix: str) -> DataFrame:
    """Highest number in use per year among references of this prefix."""
    ref = F.col(ref_column)
    return (
        existing.where(ref.startswith(f"{prefix}-"))
        .select(
            F.regexp_extract(ref, rf"^{prefix}-(\d{{4}})-\d+", 1).alias("year"),
            F.regexp_extract(ref, rf"^{prefix}-\d{{4}}-(\d+)", 1).alias("number"),
        )
        .where(F.col("year") != "")
        .groupBy(F.col("year").cast("int").alias("_year"))
        .agg(F.max(F.col("number").cast("bigint")).alias("_last"))
    )


def assign_refs(
    rows: DataFrame,
    existing: DataFrame,
    ref_column: str,
    prefix: str,
    year: Column,
    order: Sequence[Column],
) -> DataFrame:
    """Give each row the next free reference of its year, in ``order``.

    A year is one group of unbounded size, so numbering always takes the
    range-partitioned form of the running total.
    """
    dated = rows.withColumn("_year", year.cast("int"))
    numbered = running_totals(dated, ["_year"], order, {"_earlier": F.lit(1)}, hot_rows=0)
    last = last_numbers(existing, ref_column, prefix)
    number = F.coalesce("_last", F.lit(0)) + F.col("_earlier") + 1
    ref = F.concat(F.lit(f"{prefix}-"), F.col("_year").cast("string"), F.lit("-"), pad4(number))
    # One row per year on the right.
    out = numbered.join(last, "_year", "left").withColumn(ref_column, ref)
    return out.drop("_year", "_earlier", "_last")
