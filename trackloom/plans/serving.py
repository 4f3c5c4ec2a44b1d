"""Serving queries over devices, points, trips and idle segments; parameters are checked before a plan is built."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.numbers import iso_utc, round_half_up
from trackloom.operators import trips as T
from trackloom.schemas import TripConfig


class Store(NamedTuple):
    """The tables that are served. ``points`` has ``late``; trips have no id but (device_id, start_seq)."""

    points: DataFrame
    trips: DataFrame
    idle: DataFrame


def store_of(points: DataFrame, cfg: TripConfig = TripConfig()) -> Store:
    applied = points.filter("not late")
    return Store(points, T.trips(applied, cfg), T.idle_segments(applied, cfg))


def checked_limit(limit: int | str | None, default: int, most: int) -> int:
    """A whole number from 1 to ``most``; text is converted."""
    if limit is None:
        return default
    try:
        value = int(str(limit))
    except ValueError:
        raise ValueError(f"limit must be a whole number, got {limit!r}") from None
    if not 1 <= value <= most:
        raise ValueError(f"limit must be from 1 to {most}, got {value}")
    return value


def checked_device(device_id: str) -> str:
    if not 1 <= len(device_id) <= 64:
        raise ValueError("a device id has 1 to 64 characters")
    return device_id


def checked_flag(value: bool | str | None, default: bool = True) -> bool:
    if value is None:
        return default
    if value in (True, "true"):
        return True
    if value in (False, "false"):
        return False
    raise ValueError(f"expected true or false, got {value!r}")


def checked_time(value: int | str | None) -> int | None:
    """Epoch milliseconds, or ISO 8601 text (UTC where it names no zone)."""
    if value is None or isinstance(value, int):
        return value
    if re.fullmatch(r"-?\d+", value):
        return int(value)
    from datetime import datetime, timezone

    try:
        t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"not a time: {value!r}") from None
    return round((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def health(spark) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("ok"))


def stats(s: Store) -> DataFrame:
    """One row of counts: devices, points, late points, trips."""
    p = s.points.agg(F.count_distinct("device_id").alias("devices"), F.count(F.lit(1)).alias("points"), F.count_if("late").alias("late_points"))
    return p.crossJoin(s.trips.agg(F.count(F.lit(1)).alias("trips")))  # one row each


def trip_view(t: DataFrame) -> DataFrame:
    """A trip as the interface shows it: kilometres to the metre, seconds in motion, average speed to a tenth."""
    return t.select(
        "device_id", "start_seq", "end_seq", "start_ms", "end_ms",
        F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")).alias("start"), F.struct(F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")).alias("end"),
        (round_half_up(F.col("distance_m")) / 1000).alias("distance_km"), "duration_s", "idle_s", F.greatest(F.lit(0.0), F.col("duration_s") - F.col("idle_s")).alias("moving_s"),
        F.when(F.col("duration_s") > 0, round_half_up(F.col("distance_m") / F.col("duration_s") * 3.6 * 10) / 10).otherwise(F.lit(0.0)).alias("avg_speed_kph"),
        "max_speed_kph", "point_count", "end_reason",
    )


def latest(applied: DataFrame, cfg: TripConfig) -> DataFrame:
    """The last applied message of each device with the state after it, by the shuffle that the state machine needs anyhow."""
    p = T.annotated(applied, cfg).withColumn("state", T.state())
    last = p.groupBy("device_id").agg(F.max(F.struct("seq", "ts_ms", "lat", "lon", "speed_kph", "ignition", "state")).alias("l"))
    return last.select("device_id", "l.state", F.col("l.seq").alias("last_seq"), F.col("l.ts_ms").alias("last_ms"), F.col("l.lat").alias("last_lat"), F.col("l.lon").alias("last_lon"), F.col("l.speed_kph").alias("last_speed_kph"), F.col("l.ignition").alias("last_ignition"))


def trip_totals(every: DataFrame) -> DataFrame:
    """Of closed and open trips, by device: number and total length of the closed ones, and the open one as JSON."""
    closed = F.col("end_reason").isNotNull()
    under_way = F.struct(F.col("start_seq").alias("startSeq"), F.col("start_ms").alias("startTs"), F.col("distance_m").alias("distanceM"), F.col("point_count").alias("pointCount"), F.col("idle_segments").cast("int").alias("idleSegments"))
    found = every.groupBy("device_id").agg(F.count_if(closed).alias("trip_count"), F.sum(F.when(closed, F.col("distance_m"))).alias("total_m"), F.max(F.when(~closed, under_way)).alias("open"))
    return found.select("device_id", F.to_json("open").alias("open_trip"), "trip_count", "total_m")


def listed_devices(points: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """The rows of ``device_list`` from points alone: each device's last applied message, state, open trip as JSON, next number expected
    and trip totals. Open and closed trips are folded together, once."""
    applied = points.filter("not late")
    both = latest(applied, cfg).join(trip_totals(T.all_trips(applied, cfg)), "device_id", "left")
    return both.withColumn("next_seq", F.col("last_seq") + 1).fillna({"trip_count": 0, "total_m": 0.0}).orderBy("device_id")


def merged_devices(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` over ``old`` by device_id: state and open_trip are taken as they are, other nulls leave the old value."""
    as_is = {"state", "open_trip"}
    both = old.alias("o").join(new.alias("n"), "device_id", "full_outer")
    there = F.col("n.last_seq").isNotNull() | F.col("n.state").isNotNull()
    return both.select("device_id", *(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in as_is else F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns if c != "device_id"))


def device_list(devices: DataFrame, t: DataFrame) -> DataFrame:
    """All devices with number and total length of their trips, by id. Trips are aggregated before the join."""
    totals = t.groupBy("device_id").agg(F.count(F.lit(1)).alias("trip_count"), F.sum("distance_m").alias("total_m"))
    return devices.join(totals, "device_id", "left").withColumn("trip_count", F.coalesce("trip_count", F.lit(0))).withColumn("total_m", F.coalesce("total_m", F.lit(0.0))).orderBy("device_id")


def device_totals(t: DataFrame, device_id: str) -> DataFrame:
    """One row of totals of one device, zeros without trips."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return t.filter(F.col("device_id") == checked_device(device_id)).agg(F.count(F.lit(1)).alias("trips"), zero("distance_m").alias("distance_m"), zero("duration_s").alias("duration_s"), zero("idle_s").alias("idle_s"))


def overlapping(t: DataFrame, from_ms: int | str | None = None, to_ms: int | str | None = None) -> DataFrame:
    """Trips that touch the closed range; an absent bound filters nothing."""
    a, b = checked_time(from_ms), checked_time(to_ms)
    if a is not None:
        t = t.filter(F.col("end_ms") >= a)
    return t if b is None else t.filter(F.col("start_ms") <= b)


def newest(t: DataFrame, limit: int | str | None = None) -> DataFrame:
    return t.orderBy(F.desc("start_ms"), "device_id", "start_seq").limit(checked_limit(limit, 100, 1000))


def device_trips(t: DataFrame, device_id: str, from_ms=None, to_ms=None, limit=None) -> DataFrame:
    return trip_view(newest(overlapping(t.filter(F.col("device_id") == checked_device(device_id)), from_ms, to_ms), limit))


def recent_trips(t: DataFrame, from_ms=None, to_ms=None, limit=None) -> DataFrame:
    return trip_view(newest(overlapping(t, from_ms, to_ms), limit))


def newest_per_device(t: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest trips of every device; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy("device_id").orderBy(F.desc("start_ms"), F.desc("start_seq"))
    return t.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def trip_details(t: DataFrame, idle: DataFrame) -> DataFrame:
    """Trips with their idle segments as an array by start."""
    parts = idle.groupBy("device_id", "trip_start_seq").agg(F.sort_array(F.collect_list(F.struct("start_ms", "start_seq", "end_ms", "duration_s"))).alias("idle_segments"))
    return t.join(parts.withColumnRenamed("trip_start_seq", "start_seq"), ["device_id", "start_seq"], "left").withColumn("idle_segments", F.coalesce("idle_segments", F.expr("cast(array() as array<struct<start_ms:bigint,start_seq:bigint,end_ms:bigint,duration_s:double>>)")))


def track(points: DataFrame, device_id: str, from_seq=None, to_seq=None, from_ms=None, to_ms=None, include_late=None, limit=None) -> DataFrame:
    """Points of a device by number; late ones unless told otherwise."""
    p = points.filter(F.col("device_id") == checked_device(device_id))
    for bound, test in ((from_seq, F.col("seq") >= F.lit(from_seq)), (to_seq, F.col("seq") <= F.lit(to_seq)), (checked_time(from_ms), F.col("ts_ms") >= F.lit(checked_time(from_ms))), (checked_time(to_ms), F.col("ts_ms") <= F.lit(checked_time(to_ms)))):
        if bound is not None:
            p = p.filter(test)
    if not checked_flag(include_late):
        p = p.filter("not late")
    return p.orderBy("seq").limit(checked_limit(limit, 5000, 20_000))


def applied(points: DataFrame, device_id: str) -> DataFrame:
    """All points of a device that were not late, by number."""
    return points.filter(F.col("device_id") == checked_device(device_id)).filter("not late").orderBy("seq")


def trip_tracks(points: DataFrame, t: DataFrame, include_late: bool | str | None = None) -> DataFrame:
    """Each trip's points. Trips of a device don't overlap, so a point's trip is the last that starts at or before it, carried along by a
    window, if that has not ended: one shuffle by device, and time in proportion to points and trips."""
    p = points if checked_flag(include_late) else points.filter("not late")
    trip = "struct<start_seq:bigint,end_seq:bigint>"
    starts = t.select("device_id", F.col("start_seq").alias("seq"), F.struct("start_seq", "end_seq").cast(trip).alias("trip"), F.lit(0).alias("kind"))
    both = p.withColumn("trip", F.lit(None).cast(trip)).withColumn("kind", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy("device_id").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("trip", F.last("trip", ignorenulls=True).over(w)).filter("kind = 1 and seq <= trip.end_seq")
    return found.select(*p.columns, F.col("trip.start_seq").alias("start_seq"))


def projected_tracks(tracks: DataFrame, width: float = 380.0) -> DataFrame:
    """Drawing coordinates of tracks: equirectangular about the middle latitude, the longer side ``width``; x, y and ``stopped``."""
    w = Window.partitionBy("device_id", "start_seq")
    box = tracks.select("*", *(f(c).over(w).alias(n) for f, c, n in ((F.min, "lat", "lat0"), (F.max, "lat", "lat1"), (F.min, "lon", "lon0"), (F.max, "lon", "lon1"))))
    kx = F.cos(F.radians((F.col("lat0") + F.col("lat1")) / 2))
    wide, high = (F.col("lon1") - F.col("lon0")) * kx, F.col("lat1") - F.col("lat0")
    scale = F.lit(width) / F.greatest(wide, high, F.lit(1e-9))
    return box.select("device_id", "start_seq", "seq", ((F.col("lon") - F.col("lon0")) * kx * scale).alias("x"), ((F.col("lat1") - F.col("lat")) * scale).alias("y"), (F.col("speed_kph") < 3).alias("stopped"))


def last_trips(t: DataFrame) -> DataFrame:
    """The trip of highest end number of each device."""
    return t.groupBy("device_id").agg(F.max_by(F.struct("start_seq", "end_seq", "end_reason"), "end_seq").alias("t")).select("device_id", "t.*")


def end_points(points: DataFrame, t: DataFrame) -> DataFrame:
    """Where each device's last trip ended: its end point, with nulls where that is not stored."""
    last = last_trips(t).select("device_id", F.col("end_seq").alias("seq"), "end_reason")
    return last.join(points.select("device_id", "seq", "ts_ms", "lat", "lon", "speed_kph"), ["device_id", "seq"], "left")


def replay_cursors(points: DataFrame, devices: DataFrame) -> DataFrame:
    """(device_id, kind, next_seq): where a device's buffer goes on. ``absent`` without a stored device, ``unset`` where the device has
    released nothing yet, else ``number``."""
    known = devices.select("device_id", "next_seq", F.lit(True).alias("there"))
    both = points.select("device_id").distinct().join(known, "device_id", "full_outer")
    kind = F.when(F.col("there").isNull(), "absent").when(F.col("next_seq").isNull(), "unset").otherwise("number")
    return both.select("device_id", kind.alias("kind"), "next_seq")


def replay_points(points: DataFrame, t: DataFrame) -> DataFrame:
    """Applied points behind each device's last trip: what recovery feeds to the state machine again."""
    last = last_trips(t).select("device_id", "end_seq")
    return points.filter("not late").join(last, "device_id", "left").filter("end_seq is null or seq > end_seq").drop("end_seq")


def recovered(points: DataFrame, t: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """All trips, closed and open, that begin behind the last stored one, from the points behind it alone.

    The place where the last trip ended is what the next is measured from, as a parked point is, so it goes first; after a gap nothing is
    known, and the replay begins with the next point.
    """
    columns = ["device_id", "seq", "ts_ms", "lat", "lon", "speed_kph", "ignition"]
    seed = end_points(points, t).filter("end_reason <> 'gap' and ts_ms is not null").withColumn("ignition", F.lit(False)).select(columns)
    return T.all_trips(replay_points(points, t).select(columns).unionByName(seed), cfg)


def replay_marks(points: DataFrame) -> DataFrame:
    """Highest number of all points and highest event time of the applied ones, by device."""
    return points.groupBy("device_id").agg(F.max("seq").alias("max_seq"), F.max(F.when(~F.col("late"), F.col("ts_ms"))).alias("max_ms"))


def known_devices(devices: DataFrame, points: DataFrame) -> DataFrame:
    return devices.select("device_id").union(points.select("device_id")).distinct()


def recovered_trips(points: DataFrame, t: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """Trips that a replay of all applied points gives but the store lacks; none, if nothing was lost."""
    return T.trips(points.filter("not late"), cfg).join(t.select("device_id", "start_seq"), ["device_id", "start_seq"], "left_anti")


def found(df: DataFrame, what: str) -> DataFrame:
    """``df``, or ``LookupError`` where it has no row: what a request for something unknown answers."""
    if df.isEmpty():
        raise LookupError(f"{what} not found")
    return df


def as_json(df: DataFrame) -> DataFrame:
    """Each row as the JSON text of a response's body."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("body"))


def with_times(df: DataFrame, *columns: str) -> DataFrame:
    """Epoch milliseconds replaced by ISO 8601 text."""
    return df.withColumns({c: iso_utc(F.col(c)) for c in columns})


def prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    test: Column = F.col(column).startswith(F.lit(prefix + "-"))
    return df.filter(test)
