"""Extensions beyond batch parity: incremental ingest and event rollups on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.sink import chunk_id


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Append chunks as they come; ids are stable, so a batch that is replayed overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("id", chunk_id()).dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def event_rollup(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type; on a stream, windows close ``late`` after their end."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    marked = events.withWatermark("ts", gap) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
