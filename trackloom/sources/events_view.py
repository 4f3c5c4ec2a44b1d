"""The ``events`` table seen as telemetry: a device for each user, sequence numbers in order of event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.schemas import TripConfig

#: Thresholds scaled to the hours that lie between one user's events.
HOUR = 3_600_000
SCALED = TripConfig(moving_kph=30.0, gap_ms=36 * HOUR, min_idle_ms=12 * HOUR, max_idle_ms=48 * HOUR)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """device_id, seq, ts_ms, lat, lon, speed_kph, ignition, event_id from the events."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr("floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000)").alias("ts_ms"), "user_id", "event_type", "value")
    return e.select(
        F.col("user_id").cast("string").alias("device_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("seq"),
        F.col("ts_ms").cast("bigint").alias("ts_ms"),
        (F.lit(52.0) + (F.col("event_id") % 997) / F.lit(1000.0)).alias("lat"),
        (F.lit(13.0) + (F.col("event_id") % 991) / F.lit(1000.0)).alias("lon"),
        F.least("value", F.lit(400.0)).alias("speed_kph"),
        (F.col("event_type") != "error").alias("ignition"),
        "event_id",
    )
