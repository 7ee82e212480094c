"""Helpers over staged tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockline.sources.staging import staging_root


def place(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{staging_root(spark)}/llm/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and read it back; also its path, for ``forget``."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table written by ``keep`` that no frame needs any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
