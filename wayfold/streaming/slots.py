"""Fixes as a stream: counts and centroids of time slots, late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.geo import centroid
from wayfold.sources.tracks import from_events


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def slot_counts(points: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Fixes and spherical centroid of each device and slot; works on a stream and on a table."""
    a, b = centroid(F.col("latitude"), F.col("longitude"))
    timed = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("device_id", F.window("ts", span).alias("w")).agg(F.count(F.lit(1)).alias("n"), a.alias("latitude"), b.alias("longitude")).select("device_id", F.col("w.start").alias("slot_start"), "n", "latitude", "longitude")
