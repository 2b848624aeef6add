"""Streams of append-only events: windows with late data, current states, sessions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "events long, last_us long, total double"


def event_stream(spark: SparkSession, folder: str, schema: str, files_each: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and window of event time; events later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "events", "value")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Events delivered again within the time that late ones are waited for count once."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of each user's sessions: runs without a pause longer than ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def running_states(events: DataFrame) -> DataFrame:
    """user_id, events, last_us, total: the state of each user after each batch that has events of theirs (update mode)."""

    def update(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        events_, last, total = state.get if state.exists else (0, 0, 0.0)
        for frame in frames:
            events_ += len(frame)
            last = max(last, int(frame["us"].max()))
            total += float(frame["value"].fillna(0).sum())
        state.update((events_, last, total))
        yield pd.DataFrame({"user_id": [key[0]], "events": [events_], "last_us": [last], "total": [total]})

    known = events.where("user_id IS NOT NULL").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"))
    return known.groupBy("user_id").applyInPandasWithState(update, f"user_id long, {STATE}", STATE, "update", "NoTimeout")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Works through what a stream holds now and stops; a later call goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
