"""Session settings the library is written for.

On a cluster the operator supplies master, memory and ``spark.checkpoint.dir``;
``build_session`` only adds the SQL settings that the plans rely on.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SQL_SETTINGS = {
    # Runtime re-planning: coalesces small shuffle partitions, splits skewed
    # join partitions and turns small sides into broadcasts by measured size.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where the next operator would have reused the join's partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Quantities and money must fail loudly on overflow.
    "spark.sql.ansi.enabled": "true",
    # Event times are wall-clock values without a zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # transformWithState keeps its state in RocksDB.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(
    app: str = "stockline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Create (or reuse) a session; leave ``shuffle_partitions`` unset to keep the cluster's value."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
