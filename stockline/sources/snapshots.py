"""State on plain Parquet: numbered snapshots, an append-only ledger, JSON requests.

A job reads snapshot *n*, writes snapshot *n + 1* beside it and appends to the
ledger. Nothing is updated in place, so a failed run leaves the old snapshot
valid and a repeated run writes the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stockline.sources.staging import stage
from stockline.tables import SCHEMAS, Tables

CORRUPT = "_corrupt_record"


def read_snapshot(spark: SparkSession, root: str, version: int, names: Iterable[str] | None = None) -> Tables:
    """Read the named tables of one snapshot with their declared schemas."""
    base = f"{root.rstrip('/')}/snapshot={version}"
    return Tables({n: spark.read.schema(SCHEMAS[n]).parquet(f"{base}/{n}") for n in (names or SCHEMAS)})


def write_snapshot(tables: Mapping[str, DataFrame], root: str, version: int) -> str:
    """Write a complete snapshot; refuses to overwrite one that exists."""
    base = f"{root.rstrip('/')}/snapshot={version}"
    for name, frame in tables.items():
        frame.write.mode("errorifexists").parquet(f"{base}/{name}")
    return base


def append_ledger(ledger: DataFrame, path: str, batch_id: str) -> None:
    """Append ledger rows below ``path``, one folder per batch, partitioned by day and warehouse.

    Each batch owns its folder and replaces it, so re-running a batch cannot
    double its rows. Rebalancing brings a day's rows of a warehouse together for
    large files, and splits a busy one over several tasks.
    """
    (
        ledger.withColumn("ledger_date", F.to_date("created_at"))
        .hint("rebalance", F.col("ledger_date"), F.col("warehouse_code"))
        .write.mode("overwrite")
        .partitionBy("ledger_date", "warehouse_code")
        .parquet(f"{path.rstrip('/')}/batch={batch_id}")
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Read every batch of the ledger; filters on ledger_date and warehouse_code prune folders."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*")


_DAY = re.compile(r"/ledger_date=(\d{4}-\d{2}-\d{2})/")


def newest_days(ledger: DataFrame, limit: int) -> DataFrame:
    """The rows of the newest day folders, as many as hold ``limit`` rows; all rows when there are fewer.

    ``ledger`` comes from ``read_ledger``, filters included. The folder listing names
    the days; they are counted backwards, each step twice as many as the last, so the files
    read depend on ``limit`` and on how rare the wanted rows are, not on the ledger's age.
    Folders of older days are pruned from the result. Rows without a time lie behind all days.
    """
    days = sorted({d[1] for d in map(_DAY.search, ledger.inputFiles()) if d}, reverse=True)
    day = F.col("ledger_date").cast("date")
    found = start = 0
    step = 1
    while start + step < len(days):
        newest, oldest = date.fromisoformat(days[start]), date.fromisoformat(days[start + step - 1])
        found += ledger.where(day.between(F.lit(oldest), F.lit(newest))).count()
        if found >= limit:
            return ledger.where(day >= F.lit(oldest))
        start, step = start + step, step * 2
    return ledger


def read_requests(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Read a JSON request folder; returns (well-formed requests, rejects).

    Malformed documents become ``invalid_json`` rejects, as a malformed body
    was refused by the reference's endpoints.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    with_corrupt = StructType(list(schema.fields) + [StructField(CORRUPT, StringType())])
    # Parsed once and kept, because both results read it.
    raw = stage(
        spark.read.schema(with_corrupt)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path),
        "requests",
    )
    good = raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = raw.where(F.col(CORRUPT).isNotNull()).select(
        F.lit(None).cast("string").alias("request_id"),
        F.lit("invalid_json").alias("error_code"),
        F.col(CORRUPT).alias("detail"),
    )
    return good, bad


def write_json(df: DataFrame, path: str) -> None:
    """Result sink for consumers that want JSON documents instead of Parquet."""
    df.write.mode("errorifexists").json(path)
