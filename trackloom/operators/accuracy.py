"""Stored trips against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.numbers import quantile_at, round_half_up

#: Part of the distance by which a trip may be off.
TOLERANCE = 0.01


def paired(truth: DataFrame, stored: DataFrame) -> DataFrame:
    """Trips of either side of each device paired by order of start; devices whose numbers differ are left out.

    ``truth`` and ``stored`` have device_id, start_ms, distance_m and idle_s. ``error`` is null for a true distance of zero.
    """
    by_start = Window.partitionBy("device_id").orderBy("start_ms")
    every = Window.partitionBy("device_id")
    side = lambda df, p: df.select("device_id", F.row_number().over(by_start).alias("nth"), F.count(F.lit(1)).over(every).alias(f"{p}_count"), *(F.col(c).alias(f"{p}_{c}") for c in ("start_ms", "distance_m", "idle_s")))
    return side(truth, "true").join(side(stored, "stored"), ["device_id", "nth"]).filter("true_count = stored_count").withColumn("error", F.when(F.col("true_distance_m") != 0, (F.col("stored_distance_m") - F.col("true_distance_m")) / F.col("true_distance_m")))


def count_mismatches(truth: DataFrame, stored: DataFrame) -> DataFrame:
    """Devices whose numbers of trips differ: (device_id, expected, got)."""
    n = lambda df, name: df.groupBy("device_id").agg(F.count(F.lit(1)).alias(name))
    both = n(truth, "expected").join(n(stored, "got"), "device_id", "full_outer")
    return both.select("device_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("got", F.lit(0)).alias("got")).filter("expected <> got")


def comparison(truth: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: number of trips on both sides, devices that differ, greatest relative distance error and idle error in seconds."""
    p = paired(truth, stored).agg(F.coalesce(F.max(F.abs("error")), F.lit(0.0)).alias("max_distance_error"), F.coalesce(F.max(F.abs(F.col("stored_idle_s") - F.col("true_idle_s"))), F.lit(0.0)).alias("max_idle_error_s"))
    sizes = truth.agg(F.count(F.lit(1)).alias("expected_trips")).crossJoin(stored.agg(F.count(F.lit(1)).alias("actual_trips")))
    return sizes.crossJoin(count_mismatches(truth, stored).agg(F.count(F.lit(1)).alias("devices_off"))).crossJoin(p)  # one row each


def percent(x: Column) -> Column:
    return round_half_up(x * 10_000) / 100


def sweep(truth: DataFrame, stored: DataFrame) -> DataFrame:
    """One row of error statistics in percent; ``within`` counts trips strictly inside the tolerance."""
    p = paired(truth, stored).withColumn("off", F.abs("error"))
    total = lambda c: F.try_divide(F.sum(f"stored_{c}") - F.sum(f"true_{c}"), F.sum(f"true_{c}"))  # noqa: E731  null where there is nothing to compare with
    return p.agg(
        *(percent(quantile_at("off", q)).alias(n) for q, n in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"))), percent(F.max("off")).alias("max"), percent(F.avg("error")).alias("mean_signed"),
        F.count_if(F.col("off") < TOLERANCE).alias("within"), F.count(F.lit(1)).alias("compared"), percent(total("distance_m")).alias("fleet_distance"), percent(total("idle_s")).alias("fleet_idle"),
    )


def passes(truth: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: whether all trips are there and no distance is off by the tolerance or more."""
    return comparison(truth, stored).select(((F.col("devices_off") == 0) & (F.col("max_distance_error") < TOLERANCE)).alias("ok"))
