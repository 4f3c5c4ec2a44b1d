"""Deliveries written as the JSON-line files that the stream reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.ids import fleet_topic, partition_topic
from trackloom.sources.messages import payload_of


def envelopes(deliveries: DataFrame, partitions: int | None = None, published_at: Column | None = None) -> DataFrame:
    """topic, payload, published_at and arrival of telemetry rows with ``arrival``."""
    topic = fleet_topic(F.col("device_id")) if partitions is None else partition_topic(F.col("device_id"), partitions)
    return deliveries.select(topic.alias("topic"), payload_of(deliveries).alias("payload"), (F.lit(None) if published_at is None else published_at).cast("bigint").alias("published_at"), F.col("arrival").cast("bigint").alias("arrival"))


def publish(deliveries: DataFrame, path: str, files: int = 1, partitions: int | None = None) -> None:
    """Append the deliveries to a folder as ``files`` files, each a range of arrivals in order."""
    envelopes(deliveries, partitions).repartitionByRange(files, "arrival").sortWithinPartitions("arrival").write.mode("append").json(path)
