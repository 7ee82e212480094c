"""Batch jobs as streams: JSON requests in, snapshots of the state out.

A folder of JSON documents is read as a stream. Micro-batch *n* reads state version
*n* and writes version *n + 1*, whatever happens in between: a micro-batch that is
repeated reads the same version, runs the same job over the same documents and replaces
what it wrote. A version is a list that names, for each table, the version which wrote
it; so a job rewrites the tables it changes, and a version that has no list yet is not
read by anybody.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from stockline.jobs.common import JobResult
from stockline.sources.snapshots import CORRUPT, append_ledger
from stockline.tables import Tables

_LIST = "table string, version long"


def _list(spark: SparkSession, root: str, version: int) -> dict[str, int]:
    return {r["table"]: r["version"] for r in spark.read.schema(_LIST).parquet(f"{root}/versions/{version}").collect()}


def read_state(spark: SparkSession, root: str, version: int) -> Tables:
    """The tables of one version; each is read from the folder of the version that wrote it."""
    def reader(name: str, of: int):
        return lambda: spark.read.parquet(f"{root}/tables/{name}/{of}")

    return Tables({n: reader(n, of) for n, of in _list(spark, root, version).items()})


def write_state(changed: Mapping[str, DataFrame], root: str, version: int, before: int | None = None) -> None:
    """Write the changed tables, then the list that makes them a version; the others stay those of ``before``."""
    spark = next(iter(changed.values())).sparkSession
    tables = {} if before is None else _list(spark, root, before)
    for name, frame in changed.items():
        frame.write.mode("overwrite").parquet(f"{root}/tables/{name}/{version}")
        tables[name] = version
    spark.createDataFrame(list(tables.items()), _LIST).coalesce(1).write.mode("overwrite").parquet(f"{root}/versions/{version}")


def stream_requests(
    spark: SparkSession, path: str, schema: StructType | str, job: Callable[[Tables, DataFrame], JobResult], root: str,
    checkpoint: str, max_files: int | None = None, **trigger,
) -> StreamingQuery:
    """Run ``job`` over each micro-batch of JSON requests, from the state that ``write_state`` wrote as version 0.

    Results below ``root``: state versions, ``ledger``, ``accepted`` and ``rejects``, one folder per
    micro-batch. Documents that are no JSON become ``invalid_json`` rejects.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    asked = StructType(list(schema.fields)).add(CORRUPT, StringType())
    reader = spark.readStream.schema(asked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def run(batch: DataFrame, batch_id: int) -> None:
        mine = batch.sparkSession
        # Parsed once, as the job may read its requests several times.
        batch.write.mode("overwrite").parquet(f"{root}/requests/batch={batch_id}")
        kept = mine.read.schema(asked).parquet(f"{root}/requests/batch={batch_id}")
        result = job(read_state(mine, root, batch_id), kept.where(F.col(CORRUPT).isNull()).drop(CORRUPT))
        bad = kept.where(F.col(CORRUPT).isNotNull()).select(
            F.lit(None).cast("string").alias("request_id"), F.lit("invalid_json").alias("error_code"), F.col(CORRUPT).alias("detail"))
        result.rejects.unionByName(bad).write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")
        if result.accepted is not None:
            result.accepted.write.mode("overwrite").parquet(f"{root}/accepted/batch={batch_id}")
        append_ledger(result.ledger, f"{root}/ledger", str(batch_id))
        write_state(result.state, root, batch_id + 1, batch_id)

    return (
        reader.json(path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
