"""Structured Streaming twins of the windowed operators, run to the end of what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A Parquet folder as a stream; local timestamps become instants, which watermarks need."""
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").parquet(folder)
    return stream.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.simpleString() == "timestamp_ntz" else F.col(f.name) for f in like.schema))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is available into a memory table and give that."""
    name = f"drained_{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def sliding_votes(events: DataFrame, size: str = "6 hours", slide: str = "2 hours") -> DataFrame:
    """Votes by kind in sliding windows; the same plan for a batch and for a stream."""
    w = F.window("ts", size, slide)
    return events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("votes")).select(F.col("window.start").alias("start"), "event_type", "n", "votes")


def sessions(events: DataFrame, gap: str = "12 hours", late: str | None = None) -> DataFrame:
    """Sessions of a series by gap; with ``late`` a watermark bounds the state of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_log(stream: DataFrame, key: list[str], path: str, checkpoint: str) -> None:
    """Drain a stream into a Parquet log, each key once over all runs: state drops repeated keys, and a batch that
    is tried again replaces what it wrote before. A later run from the same checkpoint takes only what is new."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.dropDuplicates(key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
