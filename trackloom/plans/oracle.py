"""SQL building blocks of the oracles: the telemetry view, and the state machine as a recursive fold that shares nothing with the
window form."""

from __future__ import annotations

from trackloom.sources.events_view import SCALED as C

TELE = """tele AS (
  SELECT CAST(user_id AS VARCHAR) AS device_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq,
         epoch_us(ts) // 1000 AS ts_ms, 52e0 + (event_id % 997) / 1000e0 AS lat, 13e0 + (event_id % 991) / 1000e0 AS lon,
         least(value, 400e0) AS speed_kph, event_type <> 'error' AS ignition, event_id FROM events)"""


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    s = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"CASE WHEN {lat1} IS NOT NULL THEN 2 * 6371008.8e0 * asin(sqrt(least(1e0, {s}))) END"


POS = "STRUCT(seq BIGINT, ts BIGINT, lat DOUBLE, lon DOUBLE)"
JOURNEY = "STRUCT(seq BIGINT, ts BIGINT, lat DOUBLE, lon DOUBLE, d DOUBLE, n BIGINT, top DOUBLE, idle BIGINT, k BIGINT)"
IDLE = "STRUCT(seq BIGINT, ts BIGINT, lat DOUBLE, lon DOUBLE, d DOUBLE)"
DONE = "STRUCT(start_seq BIGINT, end_seq BIGINT, start_ms BIGINT, end_ms BIGINT, start_lat DOUBLE, start_lon DOUBLE, end_lat DOUBLE, end_lon DOUBLE, d DOUBLE, idle BIGINT, n BIGINT, top DOUBLE, why VARCHAR)"
SEGMENT = "STRUCT(trip BIGINT, seq BIGINT, a BIGINT, b BIGINT)"


def done(j: str, e: str, d: str, idle: str, n: str, top: str, why: str) -> str:
    return f"{{'start_seq': {j}.seq, 'end_seq': {e}seq, 'start_ms': {j}.ts, 'end_ms': {e}ts, 'start_lat': {j}.lat, 'start_lon': {j}.lon, 'end_lat': {e}lat, 'end_lon': {e}lon, 'd': {d}, 'idle': {idle}, 'n': {n}, 'top': {top}, 'why': '{why}'}}::{DONE}"


def fold_sql(source: str = "tele") -> str:
    """CTEs ``track`` (numbered points), ``fold`` (state after each) and ``closed`` trips of ``source``."""
    return f"""track AS (SELECT device_id AS dev, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS k, seq, ts_ms AS ts, lat, lon, speed_kph AS spd,
    CASE WHEN NOT ignition THEN 'o' WHEN speed_kph >= {C.moving_kph} THEN 'm' ELSE 's' END AS inp FROM {source}),
  fold AS (
    SELECT DISTINCT dev, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS {POS}) AS l, CAST(NULL AS {POS}) AS a, CAST(NULL AS {JOURNEY}) AS j, CAST(NULL AS {IDLE}) AS i,
           CAST(NULL AS {DONE}) AS g, CAST(NULL AS {DONE}) AS c, CAST(NULL AS {SEGMENT}) AS s FROM track
    UNION ALL
    SELECT dev, k, seq, {{'seq': seq, 'ts': ts, 'lat': lat, 'lon': lon}}::{POS},
      CASE WHEN late_stop THEN {{'seq': i1.seq, 'ts': i1.ts, 'lat': i1.lat, 'lon': i1.lon}}::{POS} WHEN inp = 'o' THEN {{'seq': seq, 'ts': ts, 'lat': lat, 'lon': lon}}::{POS}
           WHEN j1 IS NULL AND inp = 'm' THEN NULL WHEN j1 IS NULL THEN coalesce(a1, {{'seq': seq, 'ts': ts, 'lat': lat, 'lon': lon}}::{POS}) ELSE a1 END,
      CASE WHEN late_stop THEN NULL WHEN j1 IS NOT NULL AND inp = 'o' THEN NULL
           WHEN j1 IS NOT NULL THEN {{'seq': j1.seq, 'ts': j1.ts, 'lat': j1.lat, 'lon': j1.lon, 'd': j1.d + leg, 'n': j1.n + 1, 'top': greatest(j1.top, spd), 'idle': j1.idle + coalesce(rec, 0), 'k': j1.k + CASE WHEN rec IS NULL THEN 0 ELSE 1 END}}::{JOURNEY}
           WHEN inp = 'm' THEN {{'seq': seq, 'ts': ts, 'lat': coalesce(a1.lat, l1.lat, lat), 'lon': coalesce(a1.lon, l1.lon, lon),
                'd': coalesce({hav("coalesce(a1.lat, l1.lat)", "coalesce(a1.lon, l1.lon)", "lat", "lon")}, 0e0), 'n': 1, 'top': spd, 'idle': 0, 'k': 0}}::{JOURNEY} END,
      CASE WHEN j1 IS NOT NULL AND NOT late_stop AND inp = 's' THEN coalesce(i1, {{'seq': seq, 'ts': ts, 'lat': lat, 'lon': lon, 'd': j1.d + leg}}::{IDLE}) END,
      g,
      CASE WHEN late_stop THEN {done("j1", "i1.", "i1.d", "j1.idle", "j1.n", "j1.top", "idle_timeout")}
           WHEN j1 IS NOT NULL AND inp = 'o' THEN {done("j1", "", "j1.d + leg", "j1.idle + coalesce(rec, 0)", "j1.n + 1", "greatest(j1.top, spd)", "ignition_off")} END,
      CASE WHEN rec IS NOT NULL THEN {{'trip': j1.seq, 'seq': i1.seq, 'a': i1.ts, 'b': ts}}::{SEGMENT} END
    FROM (SELECT *, coalesce({hav("l1.lat", "l1.lon", "lat", "lon")}, 0e0) AS leg, j1 IS NOT NULL AND i1 IS NOT NULL AND inp = 's' AND ts - i1.ts >= {C.max_idle_ms} AS late_stop,
                 CASE WHEN j1 IS NOT NULL AND i1 IS NOT NULL AND inp <> 's' AND greatest(ts - i1.ts, 0) >= {C.min_idle_ms} THEN greatest(ts - i1.ts, 0) END AS rec
          FROM (SELECT dev, k, seq, ts, lat, lon, spd, inp, CASE WHEN NOT cut THEN j END AS j1, CASE WHEN NOT cut THEN i END AS i1, CASE WHEN NOT cut THEN l END AS l1, CASE WHEN NOT cut THEN a END AS a1,
                       CASE WHEN cut THEN {done("j", "l.", "j.d", "j.idle", "j.n", "j.top", "gap")} END AS g
                FROM (SELECT p.*, f.j, f.i, f.l, f.a, f.j IS NOT NULL AND coalesce(p.ts - f.l.ts > {C.gap_ms}, FALSE) AS cut FROM fold f JOIN track p ON p.dev = f.dev AND p.k = f.k + 1)))),
  closed AS (SELECT dev AS device_id, t.start_seq, t.end_seq, t.start_ms, t.end_ms, t.start_lat, t.start_lon, t.end_lat, t.end_lon, t.d AS distance_m,
      greatest(t.end_ms - t.start_ms, 0) / 1000e0 AS duration_s, t.idle / 1000e0 AS idle_s, CAST(t.n AS INTEGER) AS point_count, CAST(CAST(t.top AS FLOAT) AS DOUBLE) AS max_speed_kph, t.why AS end_reason
    FROM (SELECT dev, g AS t FROM fold WHERE g IS NOT NULL UNION ALL SELECT dev, c FROM fold WHERE c IS NOT NULL))"""


#: Deliveries of the telemetry: some late, some out of order, some twice with another speed, a few never.
HOUR = 3_600_000
DELIVERED = f"""sent AS (
  SELECT *, ts_ms + CASE WHEN event_id % 41 = 7 THEN {400 * HOUR} WHEN event_id % 7 = 3 THEN {30 * HOUR} ELSE 0 END + event_id % 1000 AS arrival FROM tele WHERE event_id % 53 <> 11
  UNION ALL
  SELECT device_id, seq, ts_ms, lat, lon, 1e0, ignition, event_id, ts_ms + {90 * HOUR} + event_id % 1000 FROM tele WHERE event_id % 13 = 4 AND event_id % 53 <> 11)"""
#: First arrival of each key, and whether the buffer had gone past it: a message of higher number fell out of the window before.
STORED = f"""fresh AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY device_id, seq ORDER BY arrival, speed_kph DESC) AS n FROM sent) WHERE n = 1),
  marked AS (SELECT f.*, coalesce((SELECT max(b.ts_ms) FROM fresh b WHERE b.device_id = f.device_id AND b.arrival < f.arrival)
                          - (SELECT min(b.ts_ms) FROM fresh b WHERE b.device_id = f.device_id AND b.arrival < f.arrival AND b.seq > f.seq) >= {120 * HOUR}, FALSE) AS late FROM fresh f),
  good AS (SELECT * FROM marked WHERE NOT late)"""
VIEWS = f"WITH RECURSIVE {TELE}, {DELIVERED}, {STORED}"
FOLDED = f"{VIEWS}, {fold_sql('good')}"
CLEAN = f"WITH RECURSIVE {TELE}, {fold_sql()}"
TRIP_COLUMNS = "device_id, start_seq, end_seq, start_ms, end_ms, start_lat, start_lon, end_lat, end_lon, round(distance_m, 3) AS distance_m, duration_s, idle_s, point_count, max_speed_kph, end_reason"
