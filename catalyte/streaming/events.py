"""Streams over event files: windows with watermarks, deduplication, an enrichment queue.

Every function takes and returns a DataFrame that may be streaming; ``run_available`` drives
one to the end of what is there, with exactly-once output by batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder as a stream; watermarks need ``ts`` as a timestamp with a zone."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum per event type and window."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events no more than ``gap`` apart."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return out.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def first_events(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process all that is there, then stop; ``sink`` gets each batch with its id."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def enrich_stream(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """A work queue without claims: each batch is enriched and written under its id, so a repeated batch replaces itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available(stream, sink, checkpoint)
