"""Request telemetry as a stream: statistics of event-time windows, and requests told once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.requests import derive_requests


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Requests from a growing folder of event files, with their event time `ended`."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return derive_requests(events).withColumn("ended", F.timestamp_micros("end_us"))


def windowed_stats(requests: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, status, n, mean_latency_us, output_tokens) of each window of request ends; later rows than `late` are dropped."""
    w = requests.withWatermark("ended", late).groupBy(F.window("ended", width), "status")
    s = w.agg(F.count(F.lit(1)).alias("n"), F.avg("latency_us").alias("mean_latency_us"), F.sum("output_tokens").alias("output_tokens"))
    return s.select(F.col("window.start").alias("window_start"), "status", "n", "mean_latency_us", "output_tokens")


def told_once(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Each status of a request the first time that it is told."""
    return requests.withWatermark("ended", late).dropDuplicatesWithinWatermark(["request_id", "status"])
