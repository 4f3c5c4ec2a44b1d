"""Ordered copies of the store for comparing runs, result files, and resetting a store."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.ids import partition_of
from trackloom.functions.numbers import iso_utc
from trackloom.operators import invariants
from trackloom.schemas import IDLE_SEGMENTS, TRIPS


class Snapshot(NamedTuple):
    points: DataFrame
    late: DataFrame
    trips: DataFrame
    idle: DataFrame


def snapshot(points: DataFrame, trips: DataFrame, idle: DataFrame) -> Snapshot:
    """Keys of points and late points; trips and idle segments with times as text; all in order of their keys."""
    timed = lambda df: df.withColumns({c: iso_utc(F.col(c)) for c in ("start_ms", "end_ms")})
    key = lambda df: df.select("device_id", "seq").orderBy("device_id", "seq")
    return Snapshot(key(points), key(points.filter("late")), timed(trips).orderBy("device_id", "start_seq"), timed(idle).orderBy("device_id", "start_seq"))


def differences(expected: Snapshot, got: Snapshot) -> DataFrame:
    """All lines in which two runs differ."""
    return invariants.trip_differences(expected.trips, got.trips).unionAll(invariants.idle_differences(expected.idle, got.idle)).unionAll(invariants.key_differences("late point", expected.late, got.late))


def report(delivered: DataFrame, run: Snapshot, baseline: Snapshot | None = None) -> DataFrame:
    """The verdict over a run, against a fault-free one where it is given."""
    return invariants.verdict(delivered, run.points, run.trips, run.idle, differences(baseline, run) if baseline else None)


def of_partitions(df: DataFrame, partitions: int, wanted: list[int], device: Column | None = None) -> DataFrame:
    """Rows of the devices that hash to the wanted partitions."""
    return df.filter(partition_of(F.col("device_id") if device is None else device, partitions).isin(*wanted))


def write_results(df: DataFrame, path: str) -> None:
    """A small result as JSON lines, one file, replacing what was there."""
    df.coalesce(1).write.mode("overwrite").json(path)


def reset(spark: SparkSession, base: str, point_schema: str) -> None:
    """Empty tables in place of a store's; all batches go."""
    for name, schema in (("points", point_schema), ("trips", TRIPS), ("idle_segments", IDLE_SEGMENTS)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/{name}")
