"""Streams, an extension: event counts by window, and a queue of papers still to be embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.storage import scratch_path


def window_counts(events: DataFrame, width: str = "1 hour", late: str | None = "1 day") -> DataFrame:
    """(start, event_type, n) of tumbling windows; the same for a batch and a stream, where late rows are waited for."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming and late else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Runs a stream over what is there. Each micro-batch is written under its number, so that a batch that is run
    again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def streamed_counts(spark: SparkSession, pattern: str, schema, width: str = "1 hour") -> DataFrame:
    """window_counts of a stream of Parquet files; the last update of each window counts."""
    stream = spark.readStream.schema(schema).parquet(pattern)
    path = scratch_path(spark, "stream")
    run_to_table(window_counts(stream, width), path, scratch_path(spark, "stream-state"))
    updates = spark.read.parquet(path)
    return updates.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def unembedded(new: DataFrame, done: DataFrame) -> DataFrame:
    """The embedding queue: each new paper once, without those done; new may be a stream."""
    return new.dropDuplicates(["id"]).join(done.select("id"), "id", "left_anti")
