"""Durable intermediate tables.

Some operators must read a frame several times and get exactly the same rows
each time (partition numbers from a sampled range shuffle, rounds of an
iterative job). They write it as Parquet below ``spark.checkpoint.dir``, the
shared folder that survives the loss of any executor, and read it back.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/") + "/stockline"
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/") + "/stockline"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; this job stages intermediate tables")
    root = tempfile.mkdtemp(prefix="stockline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root + "/stockline"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile remove their shuffle files when they end, not whenever the driver collects its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it.

    What was shuffled for it is not needed again, so a job's disk holds the staged tables and the shuffles of one of them.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
