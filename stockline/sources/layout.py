"""Header and line tables laid out together, so that joining them needs no shuffle.

Both tables are bucketed and sorted by the header's key into as many buckets, one file
each. A join or an aggregate on that key then reads matching buckets in place. The number
of buckets is that of the tasks such a join has, so choose it by the size of the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_together(
    headers: DataFrame, lines: DataFrame, root: str, name: str, header_key: str = "id", line_key: str = "order_id", buckets: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """Write both below ``root`` as tables ``<name>_headers`` and ``<name>_lines`` of the catalogue; returns them as read."""
    for frame, key, part in ((headers, header_key, "headers"), (lines, line_key, "lines")):
        # The shuffle and the buckets go by the same hash, so every task writes one file.
        frame.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option(
            "path", f"{root.rstrip('/')}/{part}").saveAsTable(f"{name}_{part}")
    return read_together(headers.sparkSession, name)


def read_together(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.table(f"{name}_headers"), spark.table(f"{name}_lines")
