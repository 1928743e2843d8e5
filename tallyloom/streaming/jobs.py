"""Structured Streaming jobs over the events table, and how a test drains them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need instants


def windowed_volume(events: DataFrame, window: str, slide: str | None, late: str) -> DataFrame:
    """Count, errors and value per event-time window, once the watermark has closed it."""
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = events.withWatermark("ts", late).groupBy(frame).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), "n", "errors")


def enriched(events: DataFrame, members: DataFrame, on: str) -> DataFrame:
    """Events with their member's columns: a stream joined with a table."""
    return events.join(members, on)


def answered(raised: DataFrame, answers: DataFrame, late: str, within: str) -> DataFrame:
    """Raised events with the same user's answer within the time: a join of two streams."""
    a = raised.withWatermark("ts", late).select(F.col("event_id").alias("raised_id"), F.col("user_id").alias("who"), F.col("ts").alias("raised_at"))
    b = answers.withWatermark("ts", late).select(F.col("event_id").alias("answer_id"), "user_id", F.col("ts").alias("answered_at"))
    return a.join(b, F.expr(f"who = user_id AND answered_at BETWEEN raised_at AND raised_at + INTERVAL {within}")).select("raised_id", "answer_id")


def without_repeats(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def recent_extremes(events: DataFrame, value: str, late: str, days: int = 7) -> DataFrame:
    """(end, days, total, most) of closed windows of ``days`` that slide by one: the days' totals summed, and the largest.

    Two event-time windows, one upon the other: a day's total leaves its state once the watermark has closed the day, and
    a window's once it has closed the window.
    """
    day = F.window("ts", "1 day")
    daily = events.withWatermark("ts", late).groupBy(day).agg(F.sum(F.col(value).cast("decimal(18,2)")).alias("total"))
    span = F.window(F.window_time("window"), f"{days} days", "1 day")
    return daily.groupBy(span).agg(F.count("*").alias("days"), F.sum("total").cast("double").alias("total"), F.max("total").cast("double").alias("most")).select(
        F.col("window.end").cast("timestamp_ntz").alias("end"), "days", "total", "most"
    )


def drained(stream: DataFrame, target: str) -> DataFrame:
    """Runs a stream over all input there is, into a table of its own under ``target``; the rows it wrote."""
    spark, path = stream.sparkSession, f"{target.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
