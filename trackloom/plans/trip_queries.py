"""Trips, idle segments, states, dedup and lateness over the events seen as telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import ordering, trips
from trackloom.plans.oracle import CLEAN, FOLDED, HOUR, TRIP_COLUMNS, VIEWS
from trackloom.plans.registry import query
from trackloom.schemas import ReorderConfig
from trackloom.sources.events_view import SCALED, telemetry

REORDER = ReorderConfig(window_ms=120 * HOUR, max_buffered=1_000_000)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry as an unreliable link would deliver it: ``arrival`` in ms; some late, out of order, twice or never."""
    t = telemetry(spark, sf_dir).filter("event_id % 53 <> 11")
    delay = F.when(F.col("event_id") % 41 == 7, 400 * HOUR).when(F.col("event_id") % 7 == 3, 30 * HOUR).otherwise(0)
    copies = t.filter("event_id % 13 = 4").withColumn("speed_kph", F.lit(1.0)).withColumn("arrival", F.col("ts_ms") + 90 * HOUR + F.col("event_id") % 1000)
    return t.withColumn("arrival", F.col("ts_ms") + delay + F.col("event_id") % 1000).unionByName(copies)


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ingest stores of them: first arrivals, late ones marked."""
    return ordering.with_lateness(ordering.first_arrivals(deliveries(spark, sf_dir), F.desc("speed_kph")), REORDER)


def applied_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_points(spark, sf_dir).filter("not late")


def shown(t: DataFrame) -> DataFrame:
    """Trips with distances in whole millimetres and speeds as doubles, so that engines agree."""
    return t.withColumn("distance_m", F.round("distance_m", 3)).withColumn("max_speed_kph", F.col("max_speed_kph").cast("double"))


@query("trips_closed", f"{CLEAN} SELECT {TRIP_COLUMNS} FROM closed")
def trips_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(trips.trips(telemetry(spark, sf_dir), SCALED))


@query("trips_after_faults", f"{FOLDED} SELECT {TRIP_COLUMNS} FROM closed")
def trips_after_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(trips.trips(applied_points(spark, sf_dir), SCALED))


@query("idle_segments", f"{CLEAN} SELECT f.dev AS device_id, s.trip AS trip_start_seq, s.seq AS start_seq, s.a AS start_ms, s.b AS end_ms, (s.b - s.a) / 1000e0 AS duration_s FROM fold f JOIN closed c ON c.device_id = f.dev AND c.start_seq = s.trip WHERE s IS NOT NULL")
def idle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.idle_segments(telemetry(spark, sf_dir), SCALED)


@query("open_trips", f"{CLEAN} SELECT dev AS device_id, j.seq AS start_seq, j.ts AS start_ms, round(j.d, 3) AS distance_m, CAST(j.n AS INTEGER) AS point_count, CAST(j.k AS INTEGER) AS idle_segments FROM fold f WHERE j IS NOT NULL AND k = (SELECT max(k) FROM fold b WHERE b.dev = f.dev)")
def open_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.open_trips(telemetry(spark, sf_dir), SCALED).withColumn("distance_m", F.round("distance_m", 3))


STATE = "CASE WHEN c IS NOT NULL THEN 'trip_ended' WHEN j IS NULL THEN 'parked' WHEN i IS NULL THEN 'moving' ELSE 'idle' END"


@query("device_states", f"{CLEAN} SELECT dev AS device_id, seq, {STATE} AS state FROM fold WHERE k > 0")
def device_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.states(telemetry(spark, sf_dir), SCALED)


MOVES = f"""{CLEAN}, st AS (SELECT f.dev, f.k, f.seq, {STATE} AS b, lag({STATE}) OVER (PARTITION BY f.dev ORDER BY f.k) AS a0, p.inp, p.ts - lag(p.ts) OVER (PARTITION BY f.dev ORDER BY f.k) > {SCALED.gap_ms} AS gap FROM fold f JOIN track p ON p.dev = f.dev AND p.k = f.k),
    st2 AS (SELECT *, coalesce(a0, 'parked') AS a, CASE inp WHEN 'o' THEN 'off' WHEN 's' THEN 'stationary' ELSE 'moving' END AS input FROM st),
    st3 AS (SELECT *, CASE WHEN coalesce(gap, FALSE) AND a IN ('moving', 'idle') THEN 'trip_ended' ELSE a END AS m FROM st2),
    moves AS (SELECT dev AS device_id, seq, a AS from_state, 'gap' AS input, m AS to_state, 0 AS step FROM st3 WHERE gap UNION ALL SELECT dev, seq, m, input, b, 1 FROM st3)"""


@query("transitions", f"{MOVES} SELECT device_id, seq, from_state, input, to_state, CAST(step AS INTEGER) AS step FROM moves")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.transitions(telemetry(spark, sf_dir), SCALED)


TABLE = ", ".join(str(x) for x in trips.TRANSITIONS)


@query("refused_transitions", f"{MOVES}, claimed AS (SELECT device_id, seq, from_state, input, CASE WHEN seq % 3 = 0 THEN 'idle' ELSE to_state END AS to_state FROM moves) SELECT * FROM claimed WHERE (from_state, input, to_state) NOT IN (VALUES {TABLE})")
def refused_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of claimed transitions, a third with another outcome, those that the table lacks."""
    claimed = trips.transitions(telemetry(spark, sf_dir), SCALED).withColumn("to_state", F.when(F.col("seq") % 3 == 0, "idle").otherwise(F.col("to_state")))
    return trips.refused(claimed).drop("step")


@query("trip_events", f"""{CLEAN} SELECT dev AS device_id, seq, event, recorded FROM (
    SELECT dev, seq, 'trip_ended' AS event, CAST(NULL AS BOOLEAN) AS recorded FROM fold WHERE g IS NOT NULL UNION ALL SELECT dev, seq, 'trip_ended', NULL FROM fold WHERE c IS NOT NULL UNION ALL
    SELECT dev, seq, 'trip_started', NULL FROM fold WHERE j.seq = seq UNION ALL SELECT dev, seq, 'idle_started', NULL FROM fold WHERE i.seq = seq UNION ALL
    SELECT f.dev, f.seq, 'idle_ended', f.s IS NOT NULL FROM fold f JOIN fold b ON b.dev = f.dev AND b.k = f.k - 1 WHERE b.i IS NOT NULL AND f.g IS NULL AND f.i IS NULL AND coalesce(f.c.why, '') <> 'idle_timeout')""")
def trip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips.trip_events(telemetry(spark, sf_dir), SCALED)


@query("first_arrivals", f"{VIEWS} SELECT device_id, seq, arrival, speed_kph FROM fresh")
def first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.first_arrivals(deliveries(spark, sf_dir), F.desc("speed_kph")).select("device_id", "seq", "arrival", "speed_kph")


@query("stored_points", f"{VIEWS} SELECT device_id, seq, ts_ms, late FROM marked")
def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_points(spark, sf_dir).select("device_id", "seq", "ts_ms", "late")


@query("reorder_outcomes", f"{VIEWS} SELECT device_id, count_if(late) AS refused, count(*) - count_if(late) AS accepted FROM marked GROUP BY device_id")
def reorder_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = ordering.first_arrivals(deliveries(spark, sf_dir), F.desc("speed_kph"))
    return ordering.offered(fresh, REORDER).groupBy("device_id").agg(F.count_if(F.col("outcome") != "accepted").alias("refused"), F.count_if(F.col("outcome") == "accepted").alias("accepted"))
