"""Exact deduplication by stateful streaming.

Digests of the texts flow as a stream through a keyed state in RocksDB. The state
never expires and holds, per digest, the group's size and its best row so far: the
longest original text, then the smallest ``doc_id``; with it the row number in the
digest table. Partial aggregation before the shuffle
leaves one row per digest and task, so one group may hold any share of the rows.

Groups of more than one row are checked on the full normalised texts: the smallest
and the largest text of a group must be the same. Where they are not (two texts with
one digest), the group is split by text.

Defined results: null and empty texts are equal to each other and to texts of white
space alone; ties go to the smallest ``doc_id`` (null before all), then to the row
read first; of repeated rows exactly one stays; an empty table gives an empty one;
further columns are carried by ``drop_copies`` and ignored by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockline.llm.store import keep, place, text_or_empty

_STATE = "spark.sql.streaming.stateStore"
STATE_SETTINGS = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",   # one memory limit for all stores of an executor
    f"{_STATE}.rocksdb.allowFAllocate": "false",      # many small stores would reserve disk for nothing
}


def normalised(column: str = "text") -> Column:
    """The text without white space."""
    return F.translate(text_or_empty(column), " \t\n\x0b\x0c\r", "")


def digest_of(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _best(length: str = "n_points", doc: str = "doc_id", row: str = "row_no") -> Column:
    # The smallest of these structs is the row that stays.
    return F.min(F.struct((-F.col(length)).alias("shorter"), F.col(doc).alias("doc_id"), F.col(row).alias("row_no")))


def _state(spark: SparkSession, path: str, schema, rows: int, files_per_batch: int) -> DataFrame:
    """Run the digest stream to its end; the newest state of every digest."""
    own = spark.newSession()  # its settings stay its own
    for key, value in STATE_SETTINGS.items():
        own.conf.set(key, value)
    # A stream keeps its number of stores; stores and their sizes both grow with the root of the rows.
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, round(rows**0.5 / 50))))
    stream = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    grouped = stream.groupBy("digest").agg(F.count("*").alias("group_size"), _best().alias("best"))
    changes, checkpoint = place(spark, "digest-state"), place(spark, "digest-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        # A repeated batch replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    grouped.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    state = spark.createDataFrame([], grouped.schema) if not _exists(spark, changes) else spark.read.schema(grouped.schema).parquet(changes)
    # Sizes only grow and the best row only improves, so the last change of a key is its extreme.
    return state.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.min("best").alias("best"))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def exact_groups(docs: DataFrame, files_per_batch: int = 256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256`` and the code points of its text."""
    spark = docs.sparkSession
    digests = docs.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id",
        F.length(text_or_empty()).alias("n_points"), digest_of(normalised()).alias("digest"), F.xxhash64(normalised()).alias("check"))
    rows, path = keep(digests, "digests")
    state, _ = keep(_state(spark, path, rows.schema, rows.count(), files_per_batch), "digest-groups")

    # Full bytes of every group with a second row. Ids choose the texts to digest again, rows without one included.
    grouped = rows.join(state.where("group_size > 1").select("digest"), "digest", "left_semi").select(F.col("doc_id").alias("hit_id")).distinct()
    hits = docs.select("doc_id", normalised().alias("norm")).join(grouped, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    hits = hits.select(digest_of(F.col("norm")).alias("digest"), F.xxhash64("norm").alias("check"), "norm")
    clashes, _ = keep(hits.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest"), "digest-clashes")

    plain = rows.join(clashes, "digest", "left_anti").join(state, "digest")
    # A second hash, of other bits, leads the rows of a digest with two texts back to theirs.
    split = rows.join(clashes, "digest", "left_semi").join(hits.join(clashes, "digest", "left_semi").distinct(), ["digest", "check"])
    by_text = split.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), _best().alias("best"))
    apart = split.join(by_text, ["digest", "norm"]).drop("norm")
    return plain.unionByName(apart).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("best.row_no")).alias("kept"), F.col("digest").alias("text_sha256"), "n_points")


def drop_copies(docs: DataFrame, files_per_batch: int = 256) -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep, columns as they are.

    Of rows with one id and equal texts the longest original stays; of those that are as long, any one.
    """
    stays = exact_groups(docs, files_per_batch).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_points").alias("__points")).distinct()
    own = docs.withColumn("__digest", digest_of(normalised()))
    longest = F.length(text_or_empty()) == stays["__points"]
    out = own.join(stays, own["doc_id"].eqNullSafe(stays["__id"]) & (own["__digest"] == stays["__sha"]) & longest, "left_semi")
    return out.dropDuplicates(["doc_id", "__digest"]).drop("__digest")
