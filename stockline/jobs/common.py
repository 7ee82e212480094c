"""What every batch job shares.

A job takes the state tables and a table of requests, and returns new state,
ledger rows and rejects. Requests are served in the order of their time and id;
the result is what serving them one by one would give.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

LEDGER = (
    "created_at timestamp_ntz, action string, entity_type string, entity_id string, warehouse_code string, "
    "product_id string, qty_change int, balance_after int, notes string"
)
REJECTS = "request_id string, error_code string, detail string"


@dataclass(frozen=True)
class JobResult:
    """Changed tables by name, ledger rows to append, refused requests, and the rows a caller is shown."""

    state: dict[str, DataFrame]
    ledger: DataFrame
    rejects: DataFrame
    accepted: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def rank() -> Column:
    """Serving order of requests."""
    return F.struct("requested_at", "request_id")


def reject(df: DataFrame, code: str | Column, detail: str | Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    shown = F.lit(None) if detail is None else detail
    shown = F.col(shown) if isinstance(shown, str) else shown
    return df.select(
        F.col("request_id").cast("string").alias("request_id"), code.alias("error_code"),
        shown.cast("string").alias("detail"),
    )


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def no_ledger(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], LEDGER)


def no_rejects(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], REJECTS)


def ledger_rows(
    df: DataFrame, action, entity_type: str, entity_id, notes: Column, at, warehouse=None, product=None, qty=None,
    balance=None,
) -> DataFrame:
    """Build ledger rows; arguments are columns, and ``action`` may be plain text."""
    def one(value, kind):
        return (F.lit(None) if value is None else value).cast(kind)

    return df.select(
        one(at, "timestamp_ntz").alias("created_at"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        F.lit(entity_type).alias("entity_type"), one(entity_id, "string").alias("entity_id"),
        one(warehouse, "string").alias("warehouse_code"), one(product, "string").alias("product_id"),
        one(qty, "int").alias("qty_change"), one(balance, "int").alias("balance_after"), notes.alias("notes"),
    )


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows and new ones in the existing schema; columns the new rows lack are NULL."""
    have = set(new.columns)
    return existing.unionByName(new.select(*[
        (F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in existing.dtypes
    ]))


def updated(existing: DataFrame, changes: DataFrame, key: str | list[str]) -> DataFrame:
    """Existing rows with the non-key columns of ``changes`` in place where a change exists.

    ``changes`` has at most one row per key and a boolean column ``_hit``; a
    NULL in a hit row is written.
    """
    keys = [key] if isinstance(key, str) else key
    values = [c for c in changes.columns if c not in keys and c != "_hit"]
    kinds = dict(existing.dtypes)
    renamed = changes.select(*keys, "_hit", *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = existing.join(renamed, keys, "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values
        else F.col(c) for c in existing.columns
    ])


def first_per(requests: DataFrame, key: str) -> DataFrame:
    """Mark the earliest request of each key with ``_first``; one aggregate, no group is gathered."""
    earliest = requests.groupBy(key).agg(F.min(rank()).alias("_earliest"))
    return requests.join(earliest, key, "left").withColumn(
        "_first", F.coalesce(rank() == F.col("_earliest"), F.lit(False))
    ).drop("_earliest")


def missing(*columns: str) -> Column:
    """True where any of the columns is NULL or empty text."""
    return reduce(lambda a, b: a | b, [
        F.col(c).isNull() | (F.col(c).cast("string") == "") for c in columns
    ])


OUT_OF_RANGE = "out_of_range"


def unfit(*numbers: Column) -> Column:
    """True where any of the parsed numbers does not fit its column."""
    return reduce(lambda a, b: a | b, [n.isNull() for n in numbers], F.lit(False))


def nested_lines(requests: DataFrame, column: str = "lines") -> tuple[DataFrame, DataFrame]:
    """Split requests with an array of lines into headers and flat lines numbered from 1."""
    lines = requests.select("request_id", F.posexplode(column).alias("_p", "_l")).select(
        "request_id", (F.col("_p") + 1).alias("line_no"), "_l.*"
    )
    return requests.drop(column), lines
