"""Keyed tables in hash buckets: an upsert reads and writes the buckets that its keys fall into.

A table is a folder of versions. Version *n* holds the buckets that its upsert wrote, and
``manifest/n`` names, for every bucket that has rows, the version that wrote it. Nothing
is changed in place: a version without a complete manifest is read by nobody and is
replaced by the next run, so a stopped upsert loses nothing and a repeated one writes the
same rows. Keys of any null count as values. Old versions stay readable; give the folder a
retention time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockline.jobs.common import JobResult
from stockline.sources.staging import stage
from stockline.tables import Tables

BUCKET = "_bucket"
_MANIFEST = "bucket int, version long"


@dataclass(frozen=True)
class Bucketed:
    """Where a keyed table lies; ``count`` bounds what the driver holds of it: one pair of numbers per bucket."""

    root: str
    schema: str
    keys: tuple[str, ...]
    count: int = 64

    def bucket(self) -> Column:
        # As text, so that a key falls into one bucket whatever its number type.
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.count)).cast("int")


def manifest(spark: SparkSession, table: Bucketed, version: int) -> dict[int, int]:
    """For each bucket with rows the version that wrote it."""
    return {r["bucket"]: r["version"] for r in spark.read.schema(_MANIFEST).parquet(f"{table.root}/manifest/{version}").collect()}


def touched(table: Bucketed, rows: DataFrame) -> list[int]:
    """The buckets that the keys of ``rows`` fall into, at most ``count``."""
    return sorted(r[0] for r in rows.select(table.bucket().alias(BUCKET)).distinct().collect())


def create(table: Bucketed, rows: DataFrame, version: int = 0) -> None:
    """Write a whole table as one version."""
    _write(rows.sparkSession, table, rows, {}, version)


def read(spark: SparkSession, table: Bucketed, version: int, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version; with ``buckets`` only the files of those."""
    held = manifest(spark, table, version)
    wanted = held if buckets is None else [b for b in buckets if b in held]
    paths = [f"{table.root}/rows/{held[b]}/{BUCKET}={b}" for b in wanted]
    return spark.read.schema(table.schema).parquet(*paths) if paths else spark.createDataFrame([], table.schema)


def upsert(table: Bucketed, changes: DataFrame, version: int, removed: str | None = None) -> None:
    """Write version ``version + 1``: ``changes`` take the place of the rows with their keys, or come new.

    ``changes`` has one row per key; a row whose boolean column ``removed`` is true takes its key away.
    """
    spark = changes.sparkSession
    changes = stage(changes, "changes")
    buckets = touched(table, changes)
    old = read(spark, table, version, buckets)
    named = changes.select(*[F.col(k).alias(f"_new_{k}") for k in table.keys])
    kept = old.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in table.keys]), "left_anti")
    fresh = changes.where(~F.coalesce(F.col(removed), F.lit(False))) if removed else changes
    _replace(spark, table, kept.unionByName(fresh.select(*old.columns)), buckets, version)


def run_on_buckets(
    table: Bucketed, name: str, job: Callable[[Tables, DataFrame], JobResult], t: Tables, requests: DataFrame, version: int,
) -> JobResult:
    """Run a batch job that changes only rows whose keys its requests name, and write version ``version + 1``.

    The job is given the rows of the named buckets as table ``name``; what it returns of that table replaces them.
    """
    spark = requests.sparkSession
    asked = stage(requests, "requests")
    buckets = touched(table, asked)
    result = job(t.replace(**{name: read(spark, table, version, buckets)}), asked)
    _replace(spark, table, result.state[name], buckets, version)
    return result


def _replace(spark: SparkSession, table: Bucketed, rows: DataFrame, buckets: list[int], version: int) -> None:
    others = {b: v for b, v in manifest(spark, table, version).items() if b not in set(buckets)}
    _write(spark, table, rows, others, version + 1)


def _write(spark: SparkSession, table: Bucketed, rows: DataFrame, others: dict[int, int], version: int) -> None:
    path = f"{table.root}/rows/{version}"
    marked = rows.withColumn(BUCKET, table.bucket())
    marked.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    written = [r[0] for r in spark.read.schema(marked.schema).parquet(path).select(BUCKET).distinct().collect()]
    entries = [*others.items(), *((b, version) for b in written)]
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{table.root}/manifest/{version}")
