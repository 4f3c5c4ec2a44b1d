"""Window form of trips against the state machine, and the machine against worked tracks."""

import random

import pytest

from trackloom.functions.geo import destination_point
from trackloom.operators import trips as T
from trackloom.operators.fold import Point, TripFold
from trackloom.schemas import TELEMETRY, TripConfig

T0, CFG = 1_767_254_400_000, TripConfig()


class Track:
    """5 s spacing, eastwards, moving at 36 km/h; o: off, m: moving, s: stationary."""

    def __init__(self):
        self.points, self.ts, self.lat, self.lon = [], T0, 48.137, 11.575

    def add(self, what, n=1, ms=5000):
        for _ in range(n):
            self.ts += ms
            if what == "m":
                self.lat, self.lon = destination_point(self.lat, self.lon, 90, 50)
            self.points.append(Point(len(self.points) + 1, self.ts, self.lat, self.lon, 36.0 if what == "m" else 0.0, what != "o"))
        return self


def run(track):
    fold = TripFold()
    return fold.replay(track.points), fold


def test_worked_tracks():
    assert run(Track().add("o").add("s").add("o", ms=CFG.gap_ms + 5001))[0] == []
    (t,), f = run(Track().add("o").add("m", 5).add("o"))
    assert (t["end_reason"], t["start_seq"], t["idle_s"], f.state) == ("ignition_off", 2, 0, "trip_ended")
    (t,), _ = run(Track().add("o").add("m", 3).add("s", 21).add("m").add("o"))
    assert [e - s for _, s, e in t["segments"]] == [105_000]
    (t,), _ = run(Track().add("o").add("m", 3).add("s", 3).add("m", 3).add("o"))
    assert t["segments"] == []
    (t,), _ = run(Track().add("o").add("m", 4).add("s").add("s", 30, 60_000))
    assert (t["end_reason"], t["end_seq"], t["idle_s"]) == ("idle_timeout", 6, 0) and t["point_count"] > 5
    (t,), f = run(Track().add("o").add("m", 5).add("m", ms=CFG.gap_ms + 1))
    assert t["end_reason"] == "gap" and f.journey.distance_m == 0
    assert run(Track().add("o").add("m", 2).add("m", ms=CFG.gap_ms))[0] == []
    (t,), _ = run(Track().add("o").add("m", 3).add("s", 3).add("o", ms=CFG.gap_ms + 1))
    assert t["end_reason"] == "gap" and t["segments"] == []
    assert run(Track().add("m"))[1].journey.distance_m == 0
    assert TripFold.load(f.dump()).dump() == f.dump()


def random_points(seed, devices, monotone=True):
    r = random.Random(seed)
    out = []
    for d in range(devices):
        seq, ts, lat, lon = r.randrange(5), T0, 52.5, 13.4
        for _ in range(r.randrange(60)):
            seq += r.choice([1, 1, 1, 2])
            ts += r.choice([1, 1, 2, 3, 5, 5, 11, 10]) - (0 if monotone else r.choice([0, 0, 6]))
            lat, lon = lat + r.uniform(-1, 1) / 100, lon + r.uniform(-1, 1) / 100
            out.append((f"d{d}", seq, ts, lat, lon, r.choice([0.0, 2.9, 3.0, 40.0, 40.0]), r.random() > 0.15))
    return out


def folded(rows, cfg):
    out, segments, left = [], [], []
    for d in sorted({r[0] for r in rows}):
        fold = TripFold(cfg)
        for t in fold.replay(Point(*r[1:]) for r in sorted(rows) if r[0] == d):
            out.append((d, t["start_seq"], t["end_seq"], t["start_ms"], t["end_ms"], round(t["start_lat"], 9), round(t["start_lon"], 9), round(t["end_lat"], 9), round(t["end_lon"], 9), round(t["distance_m"], 3), t["duration_s"], t["idle_s"], t["point_count"], round(t["max_speed_kph"], 3), t["end_reason"]))
            segments += [(d, t["start_seq"], s, a, b, max(0, b - a) / 1000) for s, a, b in t["segments"]]
        if j := fold.open_summary():
            left.append((d, j["start_seq"], j["start_ms"], round(j["distance_m"], 3), j["point_count"], j["idle_segments"]))
    return out, segments, left


@pytest.mark.parametrize("seed,monotone", [(1, True), (2, False)])
def test_window_form_equals_the_machine(spark, seed, monotone):
    cfg = TripConfig(3.0, 10, 6, 18)
    rows = random_points(seed, 250, monotone)
    points = spark.createDataFrame(rows, TELEMETRY)
    want, segments, left = folded(rows, cfg)
    got = [(r.device_id, r.start_seq, r.end_seq, r.start_ms, r.end_ms, round(r.start_lat, 9), round(r.start_lon, 9), round(r.end_lat, 9), round(r.end_lon, 9), round(r.distance_m, 3), r.duration_s, r.idle_s, r.point_count, round(r.max_speed_kph, 3), r.end_reason) for r in T.trips(points, cfg).collect()]
    assert sorted(got) == sorted(want) and len(want) > 300 and {t[-1] for t in want} == {"gap", "ignition_off", "idle_timeout"}
    assert sorted(map(tuple, T.idle_segments(points, cfg).collect())) == sorted(segments) and segments
    assert sorted((*r[:3], round(r[3], 3), *r[4:]) for r in T.open_trips(points, cfg).collect()) == sorted(left) and left


def test_states_transitions_and_events(spark):
    cfg = TripConfig(3.0, 10, 6, 18)
    rows = random_points(5, 120)
    points = spark.createDataFrame(rows, TELEMETRY)
    want = []
    for d in {r[0] for r in rows}:
        fold = TripFold(cfg)
        for r in sorted(x for x in rows if x[0] == d):
            fold.apply(Point(*r[1:]))
            want.append((d, r[1], fold.state))
    assert sorted(map(tuple, T.states(points, cfg).collect())) == sorted(want)
    steps = T.transitions(points, cfg).collect()
    assert {(s.from_state, s.input, s.to_state) for s in steps} == set(T.TRANSITIONS)
    closed = T.trips(points, cfg).count()
    kinds = [e.event for e in T.trip_events(points, cfg).collect()]
    assert kinds.count("trip_ended") == closed and kinds.count("trip_started") == closed + T.open_trips(points, cfg).count()
    assert kinds.count("idle_ended") <= kinds.count("idle_started")


def test_one_exchange_and_one_sort(spark):
    plan = T.trips(spark.createDataFrame([], TELEMETRY))._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning(") == 1
