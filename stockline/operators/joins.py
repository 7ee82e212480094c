"""Joins with tables that grow with the business."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from stockline.sources.staging import stage

# Rows whose shuffles the disk holds side by side, and the slices at most; each slice reads the whole table.
SLICE_ROWS, MOST_SLICES = 25_000_000, 8


def growing(side: DataFrame) -> DataFrame:
    """A join side that must be met by a shuffle, whatever its files' size.

    Spark plans a broadcast by the size of the files. Parquet keeps runs of keys and repeated texts in a few bytes
    a row, so a table of millions of rows passes as small and would be collected and hashed on the driver.
    """
    return side.hint("merge")


def in_slices(
    rows: DataFrame, keys: Sequence[str], slice_rows: int, result: Callable[[DataFrame], DataFrame], label: str
) -> DataFrame:
    """``result`` of all rows, computed for slices of about ``slice_rows`` one after the other; rows with equal ``keys`` share a slice.

    A plan holds the shuffle files of all its joins until it ends. A slice's are gone when it is staged. The last one is
    left to the caller's plan, and so is everything where one slice is enough.
    """
    slices = min(MOST_SLICES, -(-rows.count() // max(1, slice_rows)))
    if slices < 2:
        return result(rows)
    number = F.pmod(F.xxhash64(*keys), F.lit(slices))
    *first, last = [result(rows.where(number == k)) for k in range(slices)]
    out = last
    for part in first:
        out = out.unionByName(stage(part, label))
    return out
