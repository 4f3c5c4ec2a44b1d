"""Trips and idle segments as window functions over each device's points in sequence order.

Every window has the same partitioning and order with row frames, so a device's points are shuffled and sorted once, and the two
aggregations that follow need no further exchange. State that the sequential definition carries from point to point is expressed by
running counts and by the last non-null value since a reset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackloom.functions.geo import haversine_m
from trackloom.schemas import TripConfig


def by_seq() -> WindowSpec:
    return Window.partitionBy("device_id").orderBy("seq")


def so_far() -> WindowSpec:
    return by_seq().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def classify(cfg: TripConfig) -> Column:
    """off without ignition at any speed, moving from the threshold on, else stationary."""
    return F.when(~F.col("ignition"), "off").when(F.col("speed_kph") >= cfg.moving_kph, "moving").otherwise("stationary")


def count_so_far(flag: Column) -> Column:
    return F.sum(flag.cast("int")).over(so_far())


def held(*cases: tuple[Column, Column]) -> Column:
    """The value of the last row so far for which a case holds; cases are tried in order and a value may be null."""
    chosen = None
    for when, value in cases:
        boxed = F.struct(value.alias("v"))
        chosen = F.when(when, boxed) if chosen is None else chosen.when(when, boxed)
    return F.last(chosen, ignorenulls=True).over(so_far())["v"]


def position(seq: str = "seq", ts: str = "ts_ms", lat: str = "lat", lon: str = "lon") -> Column:
    return F.struct(F.col(seq).alias("seq"), F.col(ts).alias("ts"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))


def previous(name: str) -> Column:
    return F.lag(name).over(by_seq())


def annotated(points: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """Each point with its part in a trip.

    ``points`` holds one row for each device and sequence number, without late ones. Added: ``input``, ``gap``, ``on_trip``, ``starts``,
    ``times_out``, ``trip`` (number of the trip within the device), ``run`` (number of the last moving point), ``idle`` (where the idling
    of this run began), ``leg`` in metres, ``idle_from`` (on the point that ends an idle period) and ``has_next``.
    """
    nowhere = F.lit(None).cast("struct<seq:bigint,ts:bigint,lat:double,lon:double>")
    p = points.select("device_id", "seq", "ts_ms", "lat", "lon", "speed_kph", "ignition").withColumn("input", classify(cfg))
    p = p.select("*", *(previous(c).alias(f"p_{c}") for c in ("ts_ms", "lat", "lon", "input")), F.lead("seq").over(by_seq()).isNotNull().alias("has_next"))
    p = p.withColumn("gap", F.coalesce(F.col("ts_ms") - F.col("p_ts_ms") > cfg.gap_ms, F.lit(False)))
    p = p.withColumn("opens", F.col("p_input").isNull() | F.col("gap") | (F.col("p_input") == "off")).withColumn("moves", F.col("input") == "moving")
    # a trip never crosses a row that opens; before the first moving point behind such a row there is none
    p = p.withColumn("run", count_so_far(F.col("moves")))
    p = p.withColumn("may", F.col("run") > held((F.col("opens"), F.col("run") - F.col("moves").cast("int"))))
    rests = F.col("may") & (F.col("input") == "stationary")
    p = p.withColumn("idle", held((rests & (F.col("p_input") == "moving") & ~F.col("gap"), position()), (F.col("opens") | F.col("moves"), nowhere)))
    p = p.withColumn("too_long", rests & F.coalesce((F.col("seq") > F.col("idle.seq")) & (F.col("ts_ms") - F.col("idle.ts") >= cfg.max_idle_ms), F.lit(False)))
    p = p.withColumn("too_longs", count_so_far(F.col("too_long")))
    p = p.withColumn("too_longs", F.col("too_longs") - held((F.col("opens") | F.col("moves"), F.col("too_longs") - F.col("too_long").cast("int"))))
    p = p.withColumn("on_trip", F.col("may") & (F.col("too_longs") == 0)).withColumn("times_out", F.col("too_long") & (F.col("too_longs") == 1))
    p = p.select("*", *(F.coalesce(previous(c), F.lit(False)).alias(f"p_{c}") for c in ("on_trip", "times_out")), previous("idle").alias("p_idle"))
    under_way = F.col("p_on_trip") & (F.col("p_input") != "off")
    p = p.withColumn("starts", F.col("on_trip") & F.col("moves") & ~F.coalesce(under_way & ~F.col("gap"), F.lit(False)))
    closed = F.coalesce(under_way & F.col("gap"), F.lit(False))
    # where the next trip is measured from: the last parking place, the place of a timed-out stop, or the first stop seen since
    p = p.withColumn("fresh", F.col("p_input").isNull() | closed | (F.col("p_input") == "off") | F.col("p_times_out"))
    parked = F.when(F.col("p_input") == "off", F.struct(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))).when(F.col("p_times_out"), F.struct(F.col("p_idle.lat").alias("lat"), F.col("p_idle.lon").alias("lon")))
    p = p.withColumn("stops", (F.col("input") == "stationary").cast("int")).withColumn("n_stops", F.sum("stops").over(so_far()))
    p = p.withColumn("nth_stop", F.col("n_stops") - held((F.col("fresh"), F.col("n_stops") - F.col("stops"))))
    here = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    no_place = F.lit(None).cast("struct<lat:double,lon:double>")
    p = p.withColumn("anchor", F.coalesce(held((F.col("fresh"), parked)), held(((F.col("stops") == 1) & (F.col("nth_stop") == 1), here), (F.col("fresh"), no_place))))
    way = lambda lat, lon: haversine_m(lat, lon, F.col("lat"), F.col("lon"))
    p = p.withColumn("leg", F.when(F.col("starts"), F.coalesce(way(F.col("anchor.lat"), F.col("anchor.lon")), F.lit(0.0))).when(F.col("on_trip"), way(F.col("p_lat"), F.col("p_lon"))))
    ends_idle = F.col("on_trip") & ~F.col("starts") & (F.col("input") != "stationary") & (F.col("p_input") == "stationary") & F.col("p_on_trip") & ~F.col("gap")
    p = p.withColumn("idle_from", F.when(ends_idle, F.col("p_idle"))).withColumn("trip", count_so_far(F.col("starts")))
    return p.drop("opens", "may", "too_long", "too_longs", "fresh", "stops", "n_stops", "nth_stop", "p_on_trip", "p_times_out", "p_ts_ms")


def idle_ms() -> Column:
    return F.greatest(F.col("ts_ms") - F.col("idle_from.ts"), F.lit(0))


def all_trips(points: DataFrame, cfg: TripConfig = TripConfig(), segments: bool = False) -> DataFrame:
    """Closed trips and, with a null ``end_reason``, those still open at the end of a device's points; with ``segments`` also the recorded
    idle periods of each as an array.

    Distance and end of a timed-out trip are those where idling began; its count of points and top speed include the idle tail.
    """
    p = annotated(points, cfg).filter("on_trip or times_out")
    on, after = F.col("on_trip"), F.coalesce(F.col("seq") > F.col("idle.seq"), F.lit(False))
    pos = F.when(on, position())
    recorded = F.when(F.col("idle_from").isNotNull() & (idle_ms() >= cfg.min_idle_ms), idle_ms())
    runs = p.groupBy("device_id", "trip", "run").agg(
        F.sum(F.when(on, F.col("leg"))).alias("far"),
        F.coalesce(F.sum(F.when(on & after, F.col("leg"))), F.lit(0.0)).alias("tail"),
        F.count_if(on).alias("n"),
        F.max(F.when(on, F.col("speed_kph"))).alias("top"),
        F.min(pos).alias("first"),
        F.max(pos).alias("last"),
        F.max_by("input", F.when(on, F.col("seq"))).alias("last_input"),
        F.max_by("has_next", F.when(on, F.col("seq"))).alias("has_next"),
        F.max(F.when(F.col("starts"), F.struct("seq", "anchor"))).alias("start"),
        F.max(F.when(F.col("times_out"), F.col("idle"))).alias("stop"),
        F.sum(recorded).alias("idle_ms"),
        F.count(recorded).alias("n_idle"),
        *([F.collect_list(F.when(recorded.isNotNull(), F.struct(F.col("idle_from.seq").alias("seq"), F.col("idle_from.ts").alias("from_ms"), F.col("ts_ms").alias("to_ms")))).alias("segment")] if segments else []),
    )
    latest = lambda c: F.max_by(c, "run")
    t = runs.groupBy("device_id", "trip").agg(
        F.min("first").alias("first"),
        F.max("start")["anchor"].alias("anchor"),
        F.coalesce(F.max("stop"), F.max("last")).alias("end"),
        (F.sum("far") - F.sum(F.when(F.col("stop").isNotNull(), F.col("tail")).otherwise(0.0))).alias("distance_m"),
        F.coalesce(F.sum("idle_ms"), F.lit(0)).alias("idle_ms"),
        F.sum("n_idle").alias("idle_segments"),
        F.sum("n").cast("int").alias("point_count"),
        F.max("top").alias("max_speed_kph"),
        F.when(F.max("stop").isNotNull(), "idle_timeout").when(latest("last_input") == "off", "ignition_off").when(latest("has_next"), "gap").alias("end_reason"),
        *([F.flatten(F.collect_list("segment")).alias("segments")] if segments else []),
    )
    return t.select(
        "device_id", F.col("first.seq").alias("start_seq"), F.col("end.seq").alias("end_seq"), F.col("first.ts").alias("start_ms"), F.col("end.ts").alias("end_ms"),
        F.coalesce("anchor.lat", "first.lat").alias("start_lat"), F.coalesce("anchor.lon", "first.lon").alias("start_lon"), F.col("end.lat").alias("end_lat"), F.col("end.lon").alias("end_lon"),
        "distance_m", (F.greatest(F.col("end.ts") - F.col("first.ts"), F.lit(0)) / 1000).alias("duration_s"), (F.col("idle_ms") / 1000).alias("idle_s"),
        "point_count", F.col("max_speed_kph").cast("float").alias("max_speed_kph"), "end_reason", "idle_segments", *(["segments"] if segments else []),
    )


def trips(points: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """Closed trips of each device; ``points`` without late ones."""
    return all_trips(points, cfg).filter("end_reason is not null").drop("idle_segments")


def open_trips(points: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """What is known of the trip that a device is on at the end of its points; ``idle_segments`` is a count."""
    return all_trips(points, cfg).filter("end_reason is null").select("device_id", "start_seq", "start_ms", "distance_m", "point_count", F.col("idle_segments").cast("int").alias("idle_segments"))


def idle_segments(points: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """Recorded idle periods of closed trips, each with its trip's first sequence number."""
    t = all_trips(points, cfg, segments=True).filter("end_reason is not null").select("device_id", F.col("start_seq").alias("trip_start_seq"), F.explode("segments").alias("s"))
    length = F.greatest(F.col("s.to_ms") - F.col("s.from_ms"), F.lit(0)) / 1000
    return t.select("device_id", "trip_start_seq", F.col("s.seq").alias("start_seq"), F.col("s.from_ms").alias("start_ms"), F.col("s.to_ms").alias("end_ms"), length.alias("duration_s"))


def trip_events(points: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """(device_id, seq, event, recorded): trip_started, idle_started, idle_ended and trip_ended at the points that cause them."""
    p = annotated(points, cfg)
    began_idle = F.col("on_trip") & (F.col("seq") == F.col("idle.seq"))
    lost = F.col("gap") & F.coalesce(F.lag("on_trip").over(by_seq()), F.lit(False)) & (F.col("p_input") != "off")
    ends = F.col("times_out") | (F.col("on_trip") & (F.col("input") == "off"))
    every = F.array(
        F.when(lost, F.struct(F.lit("trip_ended").alias("event"), F.lit(None).cast("boolean").alias("recorded"))),
        F.when(F.col("starts"), F.struct(F.lit("trip_started").alias("event"), F.lit(None).cast("boolean").alias("recorded"))),
        F.when(began_idle, F.struct(F.lit("idle_started").alias("event"), F.lit(None).cast("boolean").alias("recorded"))),
        F.when(F.col("idle_from").isNotNull(), F.struct(F.lit("idle_ended").alias("event"), (idle_ms() >= cfg.min_idle_ms).alias("recorded"))),
        F.when(ends, F.struct(F.lit("trip_ended").alias("event"), F.lit(None).cast("boolean").alias("recorded"))),
    )
    return p.withColumn("e", every).select("device_id", "seq", F.explode(F.array_compact("e")).alias("e")).select("device_id", "seq", "e.event", "e.recorded")


#: The state machine's table (from, input, to).
TRANSITIONS = (
    ("parked", "off", "parked"), ("parked", "stationary", "parked"), ("parked", "moving", "moving"), ("parked", "gap", "parked"),
    ("moving", "moving", "moving"), ("moving", "stationary", "idle"), ("moving", "off", "trip_ended"), ("moving", "gap", "trip_ended"),
    ("idle", "stationary", "idle"), ("idle", "moving", "moving"), ("idle", "off", "trip_ended"), ("idle", "gap", "trip_ended"),
    ("trip_ended", "moving", "moving"), ("trip_ended", "stationary", "parked"), ("trip_ended", "off", "parked"), ("trip_ended", "gap", "trip_ended"),
    ("idle", "stationary", "trip_ended"),
)


def state() -> Column:
    """The state after a point, from the annotated columns."""
    ended = (F.col("on_trip") & (F.col("input") == "off")) | F.col("times_out")
    return F.when(ended, "trip_ended").when(F.col("on_trip") & (F.col("input") == "moving"), "moving").when(F.col("on_trip"), "idle").otherwise("parked")


def states(points: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """(device_id, seq, state): the state after each point."""
    return annotated(points, cfg).select("device_id", "seq", state().alias("state"))


def transitions(points: DataFrame, cfg: TripConfig = TripConfig()) -> DataFrame:
    """(device_id, seq, from_state, input, to_state, step): a gap first, then the message itself."""
    p = annotated(points, cfg).withColumn("state", state()).withColumn("before", F.coalesce(F.lag("state").over(by_seq()), F.lit("parked")))
    after_gap = F.when(F.col("gap") & F.col("before").isin("moving", "idle"), "trip_ended").otherwise(F.col("before"))
    row = lambda a, i, b, n: F.struct(a.alias("from_state"), i.alias("input"), b.alias("to_state"), F.lit(n).alias("step"))
    every = F.array(F.when(F.col("gap"), row(F.col("before"), F.lit("gap"), after_gap, 0)), row(after_gap, F.col("input"), F.col("state"), 1))
    return p.select("device_id", "seq", F.explode(F.array_compact(every)).alias("t")).select("device_id", "seq", "t.*")


def refused(moves: DataFrame) -> DataFrame:
    """Transitions (from_state, input, to_state) that the table lacks; the table is small and fixed."""
    known = moves.sparkSession.createDataFrame(TRANSITIONS, "from_state string, input string, to_state string")
    return moves.join(F.broadcast(known), ["from_state", "input", "to_state"], "left_anti")
