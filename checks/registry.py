"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import batch, live, reads
from checks.fixture import fixture, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(entries, shared) -> None:
    for key, (query, sql) in entries.items():
        QUERIES[key] = lambda spark, sf_dir, query=query: query(fixture(spark, sf_dir)[0])
        if sql is not None:
            ORACLE[key] = with_views(sql, shared)


_add(reads.READS, reads.SHARED)


def _add_jobs() -> None:
    for key, (query, sql) in batch.JOBS.items():
        QUERIES[key] = lambda spark, sf_dir, query=query: query(*fixture(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = with_views(sql, {**reads.SHARED, **batch.SHARED})


_add_jobs()


for _key, (_query, _sql) in live.STREAMS.items():
    QUERIES[_key] = _query
    if _sql is not None:
        ORACLE[_key] = with_views(_sql, live.SHARED)
