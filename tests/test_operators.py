"""Worked values for geometry, validation, checks, metrics, alerts, leases, serving parameters and settings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom import schemas
from trackloom.functions import geo, ids, numbers
from trackloom.operators import invariants, leases, metrics
from trackloom.plans import QUERIES, serving
from trackloom.sources import messages, simulator
from trackloom.sources.simulator import Fleet


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_geometry(spark):
    berlin, munich = (52.520008, 13.404954), (48.137154, 11.576124)
    assert geo.haversine(*berlin, *munich) / 1000 == pytest.approx(504.4, abs=0.5)
    assert geo.haversine(0, 0, 0, 1) == pytest.approx(111_195, abs=1)
    assert geo.haversine(0, 179.5, 0, -179.5) == pytest.approx(111_195, abs=1)
    (m,) = one(spark, geo.haversine_m(*map(F.lit, (*berlin, *munich))))
    assert m == pytest.approx(geo.haversine(*berlin, *munich), rel=1e-12)
    lat, lon = one(spark, *geo.destination(*map(F.lit, (52.0, 179.99, 90.0, 5000.0))))
    assert (lat, lon) == pytest.approx(geo.destination_point(52.0, 179.99, 90.0, 5000.0)) and lon < 0
    assert geo.haversine(52.0, 179.99, lat, lon) == pytest.approx(5000, abs=1e-3)
    assert one(spark, geo.haversine_m(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == (None,)


def test_hash_and_topics(spark):
    found = one(spark, *(ids.fnv1a32(F.lit(t)) for t in ("", "a", "foobar", "é")))
    assert found[:3] == (0x811C9DC5, 0xE40C292C, 0xBF9CF968)
    h = 2166136261
    for b in "é".encode():
        h = (h ^ b) * 16777619 % 2**32
    assert found[3] == h
    topics = ["fleet/v-1/telemetry", "telemetry/p12/v-1", "fleet//telemetry", "fleet/a/b/telemetry", "telemetry/px/v", "telemetry/p123456/v", "other"]
    got = spark.createDataFrame([(t,) for t in topics], "t string").select(ids.topic_device(F.col("t")), ids.topic_partition(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("v-1", None), ("v-1", 12), *[(None, None)] * 5]
    spread = spark.range(200).select(ids.partition_of(F.format_string("veh-%04d", "id"), 16).alias("p")).groupBy("p").count().collect()
    assert len(spread) == 16 and all(5 <= r["count"] <= 25 for r in spread)
    with pytest.raises(ValueError):
        ids.partition_of(F.lit("a"), 0)
    assert (ids.partition_filter(3), ids.partition_client("pod", 3)) == ("telemetry/p3/+", "pod-p3")


GOOD = '{"deviceId":"veh-1","seq":3,"ts":1767600000000,"lat":52.5,"lon":13.4,"speedKph":42.5,"ignition":true}'


def test_validation(spark):
    topic = "fleet/veh-1/telemetry"
    change = lambda a, b: (topic, GOOD.replace(a, b))
    bad = [
        (topic, "{"), ("fleet/veh-2/telemetry", GOOD), ("fleet/veh-1", GOOD), change(":3,", ":-1,"), change(":3,", ":1.5,"), change("52.5", "91"), change(',"ignition":true', ""),
        change("42.5", '"10"'), change("}", ',"x":1}'), change('"seq":3', '"seq":3,"seq":3'), (topic, "null"), (topic, "[]"), (topic, None), (None, GOOD), change("true", '"true"'),
        change("42.5", "400.01"), change(":3,", ":9007199254740992,"), change("1767600000000", "0"), change("veh-1", "veh 1"), change("13.4", "null"), ("telemetry/p99/veh-1", GOOD),
    ]
    good = [(topic, GOOD), change(":3,", ":3.0,"), change(":3,", ":0,"), change("52.5", "-90"), change("42.5", "400"), change("42.5", "0"), change(":3,", ":9007199254740991,")]
    partition = spark.range(1).select(ids.partition_topic(F.lit("veh-1"), 16)).first()[0]
    good.append((partition, GOOD))
    got = messages.validated(spark.createDataFrame([(i, *r) for i, r in enumerate(good + bad)], "i int, topic string, payload string"), 16).orderBy("i").collect()
    assert [r.error for r in got[: len(good)]] == [None] * len(good)
    assert all(r.error and r.device_id is None for r in got[len(good) :]), [r for r in got[len(good) :] if not r.error]
    assert (got[0].device_id, got[0].seq, got[0].ts_ms, got[0].lat, got[0].speed_kph, got[0].ignition) == ("veh-1", 3, 1767600000000, 52.5, 42.5, True)
    assert got[6].seq == 2**53 - 1


def test_trip_differences(spark):
    schema = "device_id string, start_seq bigint, distance_m double, end_reason string"
    base = spark.createDataFrame([("a", 1, 5321.123456789, "gap"), ("b", 2, 1.0, None)], schema)
    noise = spark.createDataFrame([("a", 1, 5321.123456789 + 1e-9, "gap"), ("b", 2, 1.0, None)], schema)
    assert invariants.trip_differences(base, noise).collect() == []
    other = spark.createDataFrame([("a", 1, 5321.13, "idle_timeout"), ("c", 3, 1.0, "gap")], schema)
    assert sorted(r.difference for r in invariants.trip_differences(base, other).collect()) == ["trip a#1 distance_m: expected 5321.123456789, got 5321.13", "trip a#1 end_reason: expected gap, got idle_timeout", "trip b#2 missing", "trip c#3 unexpected"]


def test_verdict(spark):
    keys = lambda *k: spark.createDataFrame(list(k), "device_id string, seq bigint")
    t = spark.createDataFrame([("a", 1), ("a", 1)], "device_id string, start_seq bigint")
    r = invariants.verdict(keys(("a", 1), ("a", 1), ("a", 2)), keys(("a", 1), ("a", 1), ("b", 9)), t, t.limit(0)).first()
    assert (r.expected, r.stored, r.lost, r.duplicates, r.duplicate_trips, r.phantom, r.ok) == (2, 3, 1, 1, 1, 1, False)
    assert invariants.verdict(keys(("a", 1)), keys(("a", 1)), t.limit(0), t.limit(0)).first().ok


def test_recovery(spark):
    samples = spark.createDataFrame([(1, 10, 5), (1, 20, 5), (1, 30, 6), (1, 40, 9), (2, 50, 1)], "run int, t long, stored long")
    healed = spark.createDataFrame([(1, 15, 8), (2, 60, 1)], "run int, healed_at long, before long")
    assert sorted(map(tuple, invariants.recovery(samples, healed).collect())) == [(1, 15, 25), (2, None, None)]


def test_latency_rule(spark):
    """100 commits a minute below 0.1 s give 0.095 s; once all take 5 to 10 s, 9.55 s, and the alert fires after five minutes."""
    fast = [(60 * i, float(min(100 * i, 1000))) for i in range(31)]
    slow = [(60 * i, 100.0 * i) for i in range(31)]
    rows = [(le, ts, v) for le, s in ((0.1, fast), (1.0, fast), (10.0, slow), (float("inf"), slow)) for ts, v in s]
    at = spark.createDataFrame([(60 * i,) for i in range(1, 31)], "eval_ts long")
    rates = metrics.rates(spark.createDataFrame(rows, "le double, ts long, value double"), at, 300, "le")
    p95 = {r.eval_ts: r.quantile for r in metrics.histogram_quantile(rates, 0.95, "eval_ts", value="rate").collect()}
    assert p95[300] == pytest.approx(0.095) and p95[1500] == pytest.approx(9.55)
    s = spark.createDataFrame([(t, v) for t, v in p95.items()], "ts long, p95 double")
    firing = {r.ts: r.firing for r in metrics.alerts(s, F.expr("p95 > 2"), 300).collect()}
    assert not firing[540] and not firing[780] and firing[1500]


def test_latency_rule_shuffles_observations_and_not_buckets(spark):
    """The quantiles of the scrapes' counts since the beginning, and no row for each bound is shuffled; nothing is broadcast."""
    rng = random.Random(5)
    seen = [(rng.randrange(3), 7 * i, rng.choice([0.0, 0.02, 0.3, 2.0, 20.0, 90.0])) for i in range(600) if rng.random() < 0.7]
    counts, scrapes = {}, []
    for pod, ts, s in seen:
        for le in [*metrics.BOUNDS, math.inf]:
            counts[pod, le] = counts.get((pod, le), 0.0) + (s <= le)
            scrapes.append((pod, ts, le, counts[pod, le]))
    at = spark.createDataFrame([(t,) for t in range(-100, 5000, 90)], "eval_ts long")
    got = metrics.observed_p95(spark.createDataFrame(seen, "pod long, ts long, s double"), at, 300, "pod")
    want = metrics.latency_p95(spark.createDataFrame(scrapes, "pod long, ts long, le double, value double"), at, 300, "pod")
    rows = lambda df: [(r.eval_ts, r.p95 if r.p95 is None else round(r.p95, 9)) for r in df.orderBy("eval_ts").collect()]
    assert rows(got) == rows(want) and len(rows(got)) > 40
    plan = QUERIES["latency_p95_rule"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1
    assert plan.count("Exchange ") == 4 and "Exchange " not in plan[: plan.index("Generate explode(array(struct(le")]


def test_other_rules(spark):
    depth = [100, 9500, 100, 100, *[9000] * 10]
    q = metrics.saturation(spark.createDataFrame([(30 * i, float(d), 10_000) for i, d in enumerate(depth)], "ts long, depth double, capacity int"))
    firing = {r.ts: r.firing for r in metrics.alerts(q, F.expr("saturation > 0.8"), 120).collect()}
    assert not firing[30] and not firing[60] and firing[300]
    assert one(spark, metrics.error_ratio(F.lit(0.0), F.lit(0.0))) == (0.0,)
    assert [a[0] for a in metrics.ALERTS] == ["FleetIngestLatencyP95High", "FleetIngestConsumerLagging", "FleetIngestErrorRatioHigh", "FleetPartitionsUnowned", "FleetIngestTargetDown"]
    line = metrics.exposition(spark.createDataFrame([("m", {"b": "2", "a": "1"}, 3.5), ("n", {}, 1.0)], "metric string, labels map<string,string>, value double"))
    assert [r.line for r in line.collect()] == ['m{a="1",b="2"} 3.5', "n 1.0"]
    empty = metrics.histogram(spark.createDataFrame([(-1.0,), (0.3,), (100.0,)], "v double"), F.col("v")).collect()
    assert [r.n for r in empty] == [1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 3]


def test_leases(spark):
    table = leases.with_partitions(spark.createDataFrame([], "partition int, owner string, holder string, token bigint, expires_ms bigint"), 4, 1000)
    assert table.count() == 4
    mine = leases.acquired(table, 0, "a~1", "a", 500, 1000)
    assert mine.filter("owner = 'a~1' and token = 1 and expires_ms = 1500").count() == 1
    assert leases.acquired(mine, 0, "b~1", "b", 500, 1200).filter("owner = 'b~1'").count() == 0
    assert leases.acquired(mine, 0, "b~1", "b", 500, 1500).filter("owner = 'b~1' and token = 2").count() == 1
    again = leases.acquired(mine, 0, "a~2", "a", 500, 1200)
    assert again.filter("owner = 'a~2' and token = 2").count() == 1
    held = spark.createDataFrame([(0, 1), (3, 1)], "partition int, token bigint")
    assert sorted(r.partition for r in leases.fenced_off(mine, held, "a~1", 1200).collect()) == [3]
    assert sorted(r.partition for r in leases.fenced_off(again, held, "a~1", 1200).collect()) == [0, 3]
    assert leases.renewed(mine, held, "a~1", 900, 1200).filter("renewed and expires_ms = 2100").count() == 1
    assert leases.released(mine, held, "a~1", 1200).filter("partition = 0 and owner is null and expires_ms = 1200").count() == 1
    assert tuple(leases.unowned(mine, 3000).first()) == (4, 2.0)
    members = spark.createDataFrame([("a~1", 9000), ("b~1", 9000), ("c~1", 10)], "member_id string, expires_ms bigint")
    assert leases.live_members(leases.heartbeat(members, "a~2", 500, 1000), "a~2", "a", 1000).first().n == 2
    assert [(r.partition, r.action) for r in leases.rebalance(mine, "a~1", "a", 2, 1200).orderBy("partition").collect()] == [(1, "acquire")]


def test_parameters():
    assert serving.checked_limit("7", 100, 1000) == 7 and serving.checked_limit(None, 100, 1000) == 100
    for bad in (0, 1001, "x", "1.5"):
        with pytest.raises(ValueError):
            serving.checked_limit(bad, 100, 1000)
    assert serving.checked_flag("false") is False and serving.checked_flag(None) is True
    for bad in ("yes", 3):
        with pytest.raises(ValueError):
            serving.checked_flag(bad)
    assert serving.checked_time("1970-01-01T00:00:01Z") == serving.checked_time("1970-01-01T01:00:01+01:00") == serving.checked_time("1000") == 1000
    for bad in ("soon", ""):
        with pytest.raises(ValueError):
            serving.checked_time(bad)
    for bad in ("", "x" * 65):
        with pytest.raises(ValueError):
            serving.checked_device(bad)


def test_settings():
    cfg = schemas.stream_config({"MOVING_KPH": "4.5", "GAP_MS": " "})
    assert (cfg.trip.moving_kph, cfg.trip.gap_ms) == (4.5, 300_000)
    for bad in ("x", "nan", "inf"):
        with pytest.raises(ValueError):
            schemas.stream_config({"MOVING_KPH": bad})


def test_numbers(spark):
    assert one(spark, numbers.round_half_up(F.lit(-2.5)), numbers.round_half_up(F.lit(2.5))) == (-2, 3) and numbers.half_up(-2.5) == -2
    assert one(spark, numbers.iso_utc(F.lit(1_767_254_400_123))) == ("2026-01-01T08:00:00.123Z",)
    assert one(spark, numbers.duration_text(F.lit(3_900.0)), numbers.duration_text(F.lit(59.4))) == ("1 h 05 min", "59 s")
    q = spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double").agg(numbers.quantile_at("x", 0.5), numbers.quantile_at("x", 0.95)).first()
    assert tuple(q) == (2.0, 4.0)


def test_prefixes(spark):
    df = spark.createDataFrame([("a_%-1",), ("abc-1",), ("a_%x-1",)], "device_id string")
    assert [r.device_id for r in serving.prefixed(df, "device_id", "a_%").collect()] == ["a_%-1"]


def test_simulator():
    r = simulator.Random32(42)
    first = [r.next() for _ in range(3)]
    assert first == pytest.approx([0.6011037519201636, 0.44829055899754167, 0.8524657934904099])
    messages_, truth = simulator.simulate(Fleet(seed=5, devices=3, trips=2))
    assert len(truth) == 6 and len({(m[0], m[1]) for m in messages_}) == len(messages_)
    assert simulator.simulate(Fleet(seed=5, devices=3, trips=2)) == (messages_, truth)


def test_merge_keeps_old_values(spark):
    schema = "device_id string, state string, last_seq bigint, open_trip string"
    old = spark.createDataFrame([("a", "idle", 5, "t"), ("b", "moving", 6, "u")], schema)
    new = spark.createDataFrame([("a", None, None, None), ("c", "parked", 1, None)], schema)
    got = {r.device_id: tuple(r)[1:] for r in serving.merged_devices(old, new).collect()}
    assert got["b"] == ("moving", 6, "u") and got["c"] == ("parked", 1, None) and got["a"][1] == 5


def test_queries_compare_whole_trips(spark):
    """Columns that only an interior point changes are compared, and the verdict counts trips and differences."""
    from trackloom.plans import QUERIES

    lines = [r.difference for r in QUERIES["trip_column_differences"](spark, "/root/testdata/sf0.001").collect()]
    assert {"point_count", "distance_m"} <= {x.rsplit(" ", 1)[1] for x in lines}
    got = QUERIES["stored_verdict"](spark, "/root/testdata/sf0.001").first()
    assert got.duplicate_trips > 0 and got.differences >= len(lines) > 0 and not got.ok


def test_applied_track_has_no_limit(spark, monkeypatch):
    from trackloom.plans import serving_queries

    points = spark.range(6001).selectExpr(f"'{serving_queries.DEVICE}' as device_id", "id as seq", "id as ts_ms", "id % 1000 = 1 as late")
    monkeypatch.setattr(serving_queries, "stored_points", lambda *_: points)
    got = [r.seq for r in serving_queries.applied_track(spark, "").collect()]
    assert got == [i for i in range(6001) if i % 1000 != 1]


def test_bodies_and_unknown_things(spark):
    import json

    trips = spark.createDataFrame([("a", 3, 1_767_254_400_123, 1.5)], "device_id string, start_seq bigint, start_ms bigint, distance_m double")
    (body,) = serving.as_json(serving.with_times(trips, "start_ms")).first()
    assert json.loads(body) == {"device_id": "a", "start_seq": 3, "start_ms": "2026-01-01T08:00:00.123Z", "distance_m": 1.5}
    assert serving.found(trips, "device a").count() == 1
    with pytest.raises(LookupError):
        serving.found(trips.limit(0), "device b")


def test_live_check(spark):
    from trackloom.operators import accuracy

    truth = spark.createDataFrame([("a", 1, 100.0, 0.0), ("a", 9, 0.0, 0.0)], "device_id string, start_ms bigint, distance_m double, idle_s double")
    assert accuracy.passes(truth, truth).first().ok
    off = truth.withColumn("distance_m", F.col("distance_m") * 1.02)
    assert not accuracy.passes(truth, off).first().ok and not accuracy.passes(truth, truth.limit(1)).first().ok
    assert accuracy.sweep(truth, off).first().max == 2.0


def test_five_alerts(spark):
    """What each alert fires on, and for how long it must hold."""
    quiet = {"p95": 0.1, "saturation": 0.1, "paused": 0, "ratio": 0.0, "unowned_s": 0.0, "up": 1}
    bad = {"FleetIngestLatencyP95High": {"p95": 3.0}, "FleetIngestConsumerLagging": {"paused": 1}, "FleetIngestErrorRatioHigh": {"ratio": 0.2}, "FleetPartitionsUnowned": {"unowned_s": 31.0}, "FleetIngestTargetDown": {"up": 0}}
    rows = [(i, ts, *(quiet | (change if ts >= 60 else {})).values()) for i, change in enumerate(bad.values()) for ts in range(0, 600, 30)]
    got = metrics.every_alert(spark.createDataFrame(rows, "pod int, ts long, p95 double, saturation double, paused int, ratio double, unowned_s double, up int"), "pod").filter("firing").groupBy("alert", "pod").agg(F.min("ts").alias("at")).collect()
    held = {name: for_s for name, _, for_s, _ in metrics.ALERTS}
    assert {(r.alert, r.pod): r["at"] for r in got} == {(name, i): 60 + held[name] for i, name in enumerate(bad)}


def test_trip_tracks_need_no_join_by_device(spark):
    points = spark.createDataFrame([("a", i, i * 10, i == 4) for i in range(12)] + [("b", 5, 1, False)], "device_id string, seq bigint, ts_ms bigint, late boolean")
    t = spark.createDataFrame([("a", 2, 5), ("a", 8, 9)], "device_id string, start_seq bigint, end_seq bigint")
    tracks = serving.trip_tracks(points, t)
    assert sorted((r.device_id, r.start_seq, r.seq) for r in tracks.collect()) == [("a", 2, s) for s in (2, 3, 4, 5)] + [("a", 8, 8), ("a", 8, 9)]
    assert sorted(r.seq for r in serving.trip_tracks(points, t, "false").collect()) == [2, 3, 5, 8, 9]
    assert "Join" not in tracks._jdf.queryExecution().executedPlan().toString()
