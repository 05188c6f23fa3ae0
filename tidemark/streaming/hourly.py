"""Streaming forms of the hourly series, an extension beyond the batch evaluation.

Late rows are taken for as long as the watermark allows; after that an hour is final and is sent once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def event_stream(spark: SparkSession, folder: str, name: str = "events*.parquet", files: int = 1) -> DataFrame:
    """Files of events as they arrive in a folder, some at a time."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def hourly(events: DataFrame, delay: str = "2 hours", window: str = "1 hour") -> DataFrame:
    """(domain, start_ts, ot, n): sums per hour and event type, final once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    sums = timed.groupBy(F.window("ts", window), "event_type").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("ot"), F.count("*").alias("n"))
    return sums.select(F.col("event_type").alias("domain"), F.col("window.start").alias("start_ts"), "ot", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """(user_id, start_ts, end_ts, n): runs of a user's events without a gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    runs = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return runs.select("user_id", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n")


def facts_before_origins(origins: DataFrame, facts: DataFrame, history: str = "24 hours", delay: str = "2 hours") -> DataFrame:
    """Stream-stream join of the point-in-time rule: facts of the domain from history before an origin until it, not at it."""
    o = origins.withWatermark("cutoff", delay).alias("o")
    f = facts.withWatermark("end_ts", delay).alias("f")
    return o.join(f, F.expr(f"o.domain = f.domain AND f.end_ts >= o.cutoff - INTERVAL {history} AND f.end_ts < o.cutoff")).select("o.domain", "o.cutoff", "f.fact_id", "f.end_ts")
