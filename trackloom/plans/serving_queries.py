"""Serving queries registered with their SQL, over trips of the faulty deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.plans import serving as S
from trackloom.plans.oracle import FOLDED, VIEWS
from trackloom.plans.registry import query
from trackloom.plans.trip_queries import stored_points
from trackloom.sources.events_view import SCALED, table

FROM_MS, TO_MS, DEVICE = 1_704_500_000_000, 1_706_000_000_000, "7"


def store(spark: SparkSession, sf_dir: str) -> S.Store:
    return S.store_of(stored_points(spark, sf_dir), SCALED)


#: round(x) with halves upwards.
KM, AVG = "floor(distance_m + 0.5) / 1000e0", "CASE WHEN duration_s > 0 THEN floor(distance_m / duration_s * 3.6e0 * 10e0 + 0.5e0) / 10e0 ELSE 0e0 END"
VIEW = f"device_id, start_seq, end_seq, start_ms, end_ms, start_lat AS s_lat, end_lon AS e_lon, {KM} AS distance_km, duration_s, idle_s, greatest(0e0, duration_s - idle_s) AS moving_s, {AVG} AS avg_speed_kph, max_speed_kph, point_count, end_reason"


def flat(view: DataFrame) -> DataFrame:
    return view.withColumn("s_lat", F.col("start.lat")).withColumn("e_lon", F.col("end.lon")).drop("start", "end").withColumn("max_speed_kph", F.col("max_speed_kph").cast("double"))


@query("health", "SELECT 1 AS ok")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.health(spark)


@query("store_stats", f"{FOLDED} SELECT (SELECT count(DISTINCT device_id) FROM marked) AS devices, (SELECT count(*) FROM marked) AS points, (SELECT count(*) FROM marked WHERE late) AS late_points, (SELECT count(*) FROM closed) AS trips")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stats(store(spark, sf_dir))


@query("recent_trips", f"{FOLDED} SELECT {VIEW} FROM closed ORDER BY start_ms DESC, device_id, start_seq LIMIT 100")
def recent_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(S.recent_trips(store(spark, sf_dir).trips))


@query("device_trips", f"{FOLDED} SELECT {VIEW} FROM closed WHERE device_id = '{DEVICE}' AND end_ms >= {FROM_MS} AND start_ms <= {TO_MS} ORDER BY start_ms DESC, start_seq LIMIT 100")
def device_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(S.device_trips(store(spark, sf_dir).trips, DEVICE, FROM_MS, TO_MS))


@query("newest_trips_per_device", f"{FOLDED} SELECT device_id, start_seq, start_ms, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY device_id ORDER BY start_ms DESC, start_seq DESC) AS INTEGER) AS nth FROM closed) WHERE nth <= 3")
def newest_per_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.newest_per_device(store(spark, sf_dir).trips, 3).select("device_id", "start_seq", "start_ms", "nth")


LAST = f"last AS (SELECT g.device_id, g.seq, g.ts_ms, g.lat, g.lon, g.speed_kph, g.ignition FROM good g WHERE g.seq = (SELECT max(seq) FROM good b WHERE b.device_id = g.device_id)), ends AS (SELECT * FROM fold f WHERE k > 0 AND k = (SELECT max(k) FROM fold b WHERE b.dev = f.dev))"


@query("device_list", f"""{FOLDED}, {LAST} SELECT l.device_id, CASE WHEN e.c IS NOT NULL THEN 'trip_ended' WHEN e.j IS NULL THEN 'parked' WHEN e.i IS NULL THEN 'moving' ELSE 'idle' END AS state, l.seq AS last_seq, l.ts_ms AS last_ms, l.lat AS last_lat, l.lon AS last_lon,
    l.speed_kph AS last_speed_kph, l.ignition AS last_ignition, l.seq + 1 AS next_seq, e.j.seq AS open_start, e.j.ts AS open_ms, round(e.j.d, 3) AS open_m, e.j.n AS open_points, e.j.k AS open_idle, coalesce(t.n, 0) AS trip_count, round(coalesce(t.d, 0e0), 3) AS total_m
    FROM last l JOIN ends e ON e.dev = l.device_id LEFT JOIN (SELECT device_id, count(*) AS n, sum(distance_m) AS d FROM closed GROUP BY device_id) t ON t.device_id = l.device_id""")
def device_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.listed_devices(stored_points(spark, sf_dir), SCALED)
    part = lambda name, kind: F.get_json_object("open_trip", f"$.{name}").cast(kind)
    opened = {"open_start": part("startSeq", "bigint"), "open_ms": part("startTs", "bigint"), "open_m": F.round(part("distanceM", "double"), 3), "open_points": part("pointCount", "bigint"), "open_idle": part("idleSegments", "bigint")}
    return found.withColumns(opened).withColumn("total_m", F.round("total_m", 3)).drop("open_trip")


@query("device_totals", f"{FOLDED} SELECT count(*) AS trips, round(coalesce(sum(distance_m), 0e0), 3) AS distance_m, coalesce(sum(duration_s), 0e0) AS duration_s, coalesce(sum(idle_s), 0e0) AS idle_s FROM closed WHERE device_id = '{DEVICE}'")
def device_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.device_totals(store(spark, sf_dir).trips, DEVICE).withColumn("distance_m", F.round("distance_m", 3)).withColumn("duration_s", F.round("duration_s", 6)).withColumn("idle_s", F.round("idle_s", 6))


@query("trip_details", f"""{FOLDED} SELECT c.device_id, c.start_seq, count(f.q) AS n_idle, coalesce(string_agg(f.q || ':' || f.a || ':' || f.b, ',' ORDER BY f.a, f.q), '') AS segments
    FROM closed c LEFT JOIN (SELECT dev, s.trip AS t, s.seq AS q, s.a AS a, s.b AS b FROM fold WHERE s IS NOT NULL) f ON f.dev = c.device_id AND f.t = c.start_seq GROUP BY c.device_id, c.start_seq""")
def trip_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    text = lambda x: F.concat_ws(":", x["start_seq"].cast("string"), x["start_ms"].cast("string"), x["end_ms"].cast("string"))
    return S.trip_details(s.trips, s.idle).select("device_id", "start_seq", F.size("idle_segments").cast("bigint").alias("n_idle"), F.concat_ws(",", F.transform("idle_segments", text)).alias("segments"))


@query("device_track", f"{VIEWS} SELECT seq, ts_ms, lat, lon, late FROM marked WHERE device_id = '{DEVICE}' AND seq BETWEEN 5 AND 60 AND ts_ms <= {TO_MS} ORDER BY seq LIMIT 40")
def device_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.track(stored_points(spark, sf_dir), DEVICE, 5, 60, to_ms=TO_MS, limit=40).select("seq", "ts_ms", "lat", "lon", "late")


@query("applied_track", f"{VIEWS} SELECT seq, ts_ms FROM good WHERE device_id = '{DEVICE}'")
def applied_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applied points of the device; ``serving.track`` is an interface and limits its rows."""
    return S.applied(stored_points(spark, sf_dir), DEVICE).select("seq", "ts_ms")


@query("trip_tracks", f"{FOLDED} SELECT c.device_id, c.start_seq, m.seq, m.late FROM closed c JOIN marked m ON m.device_id = c.device_id AND m.seq BETWEEN c.start_seq AND c.end_seq")
def trip_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return S.trip_tracks(s.points, s.trips).select("device_id", "start_seq", "seq", "late")


BOX = "min(lat) OVER w AS lat0, max(lat) OVER w AS lat1, min(lon) OVER w AS lon0, max(lon) OVER w AS lon1"


@query("projected_tracks", f"""{FOLDED}, tr AS (SELECT c.device_id, c.start_seq, m.seq, m.lat, m.lon, m.speed_kph, {BOX.replace('(lat)', '(m.lat)').replace('(lon)', '(m.lon)')} FROM closed c JOIN marked m ON m.device_id = c.device_id AND m.seq BETWEEN c.start_seq AND c.end_seq WINDOW w AS (PARTITION BY c.device_id, c.start_seq)),
    sc AS (SELECT *, cos(radians((lat0 + lat1) / 2)) AS kx FROM tr), s2 AS (SELECT *, 380e0 / greatest((lon1 - lon0) * kx, lat1 - lat0, 1e-9) AS scale FROM sc)
    SELECT device_id, start_seq, seq, round((lon - lon0) * kx * scale, 6) AS x, round((lat1 - lat) * scale, 6) AS y, speed_kph < 3 AS stopped FROM s2""")
def projected_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return S.projected_tracks(S.trip_tracks(s.points, s.trips)).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("replay_last_trips", f"{FOLDED} SELECT device_id, start_seq, end_seq, end_reason FROM closed c WHERE end_seq = (SELECT max(end_seq) FROM closed b WHERE b.device_id = c.device_id)")
def replay_last_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_trips(store(spark, sf_dir).trips)


@query("replay_end_points", f"{FOLDED} SELECT c.device_id, c.end_seq AS seq, c.end_reason, m.ts_ms, m.lat, m.lon FROM closed c LEFT JOIN marked m ON m.device_id = c.device_id AND m.seq = c.end_seq WHERE c.end_seq = (SELECT max(end_seq) FROM closed b WHERE b.device_id = c.device_id)")
def replay_end_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return S.end_points(s.points, s.trips).drop("speed_kph")


@query("replay_cursors", f"""{VIEWS}, d AS (SELECT CAST(c_custkey AS VARCHAR) AS device_id, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS BIGINT) * 3 END AS next_seq FROM customer WHERE c_custkey % 3 <> 0), p AS (SELECT DISTINCT device_id FROM marked)
    SELECT coalesce(p.device_id, d.device_id) AS device_id, CASE WHEN d.device_id IS NULL THEN 'absent' WHEN next_seq IS NULL THEN 'unset' ELSE 'number' END AS kind, next_seq FROM p FULL JOIN d ON d.device_id = p.device_id""")
def replay_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    devices = table(spark, sf_dir, "customer").filter(k % 3 != 0).select(k.cast("string").alias("device_id"), F.when(k % 4 != 0, k.cast("bigint") * 3).alias("next_seq"))
    return S.replay_cursors(stored_points(spark, sf_dir), devices)


@query("recovered_open_trips", f"{FOLDED} SELECT dev AS device_id, j.seq AS start_seq, j.ts AS start_ms, j.lat AS start_lat, j.lon AS start_lon, round(j.d, 3) AS distance_m, CAST(j.n AS INTEGER) AS point_count FROM fold f WHERE j IS NOT NULL AND k = (SELECT max(k) FROM fold b WHERE b.dev = f.dev)")
def recovered_open_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay from the last stored trip on gives the trips under way that the whole history does, and none that is stored."""
    s = store(spark, sf_dir)
    return S.recovered(s.points, s.trips, SCALED).select("device_id", "start_seq", "start_ms", "start_lat", "start_lon", F.round("distance_m", 3).alias("distance_m"), "point_count")


@query("replay_points", f"{FOLDED} SELECT g.device_id, g.seq FROM good g LEFT JOIN (SELECT device_id, max(end_seq) AS e FROM closed GROUP BY device_id) t ON t.device_id = g.device_id WHERE t.e IS NULL OR g.seq > t.e")
def replay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = store(spark, sf_dir)
    return S.replay_points(s.points, s.trips).select("device_id", "seq")


@query("replay_marks", f"{VIEWS} SELECT device_id, max(seq) AS max_seq, max(ts_ms) FILTER (WHERE NOT late) AS max_ms FROM marked GROUP BY device_id")
def replay_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.replay_marks(stored_points(spark, sf_dir))


@query("known_devices", f"{VIEWS} SELECT device_id FROM good UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer")
def known_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.known_devices(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("device_id")), stored_points(spark, sf_dir).filter("not late"))


@query("recovered_trips", f"{FOLDED} SELECT device_id, start_seq FROM closed WHERE start_seq % 3 = 0")
def recovered_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store has lost every third trip; the replay of its points gives them back."""
    s = store(spark, sf_dir)
    return S.recovered_trips(s.points, s.trips.filter("start_seq % 3 <> 0"), SCALED).select("device_id", "start_seq")


@query("customer_orders", """SELECT c_custkey AS device_id, coalesce(n, 0) AS trip_count, round(coalesce(total, 0e0), 2) AS total_m FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DOUBLE)) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of devices over other tables: customers with number and total of their orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("device_id"), F.col("o_totalprice").cast("double").alias("distance_m"))
    return S.device_list(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id")), orders).withColumn("total_m", F.round("total_m", 2))


@query("merged_devices", f"""WITH RECURSIVE tele AS (SELECT 1 AS x), o AS (SELECT CAST(c_custkey AS VARCHAR) AS device_id, 'parked' AS state, CAST(c_custkey AS BIGINT) AS last_seq, 'open' AS open_trip FROM customer WHERE c_custkey % 2 = 0),
    n AS (SELECT CAST(c_custkey AS VARCHAR) AS device_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'moving' END AS state, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS BIGINT) * 10 END AS last_seq, CAST(NULL AS VARCHAR) AS open_trip FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey % 5 <> 0 OR c_custkey % 7 <> 0))
    SELECT coalesce(o.device_id, n.device_id) AS device_id, CASE WHEN n.device_id IS NOT NULL THEN n.state ELSE o.state END AS state, coalesce(n.last_seq, o.last_seq) AS last_seq, CASE WHEN n.device_id IS NOT NULL THEN n.open_trip ELSE o.open_trip END AS open_trip FROM o FULL JOIN n ON n.device_id = o.device_id""")
def merged_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    old = c.filter("k % 2 = 0").select(F.col("k").cast("string").alias("device_id"), F.lit("parked").alias("state"), F.col("k").cast("bigint").alias("last_seq"), F.lit("open").alias("open_trip"))
    new = c.filter("k % 3 = 0 and (k % 5 <> 0 or k % 7 <> 0)").select(F.col("k").cast("string").alias("device_id"), F.when(F.col("k") % 5 != 0, "moving").alias("state"), F.when(F.col("k") % 7 != 0, F.col("k").cast("bigint") * 10).alias("last_seq"), F.lit(None).cast("string").alias("open_trip"))
    return S.merged_devices(old, new)
