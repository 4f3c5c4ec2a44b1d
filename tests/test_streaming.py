"""The stream against a batch fold, with and without a restart, and the simulator's truth."""

import json

import pytest

from trackloom.operators import accuracy, trips
from trackloom.operators.fold import Point, ReorderBuffer, TripFold
from trackloom.schemas import ReorderConfig, StreamConfig, TripConfig
from trackloom.sources.simulator import Faults, Fleet, delivered, fleet_frames, simulate
from trackloom.streaming import ingest


def final_states(sent):
    """Machines and cursors of all devices after one pass in arrival order."""
    buffers, folds, seen = {}, {}, set()
    for m in sent:
        if (m[0], m[1]) not in seen:
            seen.add((m[0], m[1]))
            for p in buffers.setdefault(m[0], ReorderBuffer()).offer(Point(*m[1:]))[1]:
                folds.setdefault(m[0], TripFold()).apply(p)
            folds.setdefault(m[0], TripFold())
    return folds, {d: b.cursor for d, b in buffers.items()}


def write(path, rows, name):
    path.mkdir(exist_ok=True)
    lines = [json.dumps({"topic": f"fleet/{m[0]}/telemetry", "arrival": i, "payload": json.dumps(dict(zip(("deviceId", "seq", "ts", "lat", "lon", "speedKph", "ignition"), m)))}) for i, m in rows]
    (path / f".{name}").write_text("\n".join(lines))
    (path / f".{name}").rename(path / f"{name}.json")


def expected(sent):
    """Late keys, trips and idle segments by one pass in arrival order, without a final flush."""
    seen, buffers, folds, late, closed = set(), {}, {}, set(), []
    for m in sent:
        if (m[0], m[1]) in seen:
            continue
        seen.add((m[0], m[1]))
        buffer, fold = buffers.setdefault(m[0], ReorderBuffer()), folds.setdefault(m[0], TripFold())
        outcome, released = buffer.offer(Point(*m[1:]))
        if outcome != "accepted":
            late.add((m[0], m[1]))
        for p in released:
            closed += [(m[0], t["start_seq"], t["end_seq"], t["end_reason"], round(t["distance_m"], 3), t["point_count"]) for t in fold.apply(p)]
    return seen, late, sorted(closed)


@pytest.mark.parametrize("stops", [[], [900, 1700]])
def test_stream_equals_fold_after_restarts(spark, tmp_path, stops):
    messages, _ = simulate(Fleet(seed=99, devices=4, trips=2))
    sent = [m for _, m, _ in delivered(messages, Faults(seed=100, late=0.02))[0]]
    numbered = list(enumerate(sent))
    cuts = [0, *stops, len(sent)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        write(tmp_path / "in", numbered[a:b], f"part{k}")
        ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), StreamConfig(max_files_per_trigger=1), timers=False, availableNow=True).awaitTermination()
    points, t, idle = ingest.read_store(spark, str(tmp_path / "out"))
    seen, late, closed = expected(sent)
    got = points.collect()
    assert len(got) == len(seen) and {(r.device_id, r.seq) for r in got} == seen
    assert {(r.device_id, r.seq) for r in got if r.late} == late and late
    assert sorted((r.device_id, r.start_seq, r.end_seq, r.end_reason, round(r.distance_m, 3), r.point_count) for r in t.collect()) == closed and closed
    folds, cursors = final_states(sent)
    devices = {r.device_id: r for r in ingest.read_devices(spark, str(tmp_path / "out")).collect()}
    assert set(devices) == set(folds)
    for d, fold in folds.items():
        assert devices[d].state == fold.state and devices[d].next_seq == cursors[d]
        assert (devices[d].last_seq, devices[d].open_trip is None) == (fold.last.seq if fold.last else None, fold.journey is None)
    # the same trips from the stored points in one batch; what the buffers still hold back may add one to a device
    again = {(r.device_id, r.start_seq): r.end_seq for r in trips.trips(points.filter("not late")).collect()}
    assert all(again[d, s] == e for d, s, e, *_ in closed)
    assert all(r.trip_start_seq <= r.start_seq for r in idle.collect())


def test_quiet_devices_are_flushed(spark, tmp_path):
    write(tmp_path / "in", [(i, ("d", i + 5, 1_767_600_000_000 + i, 52.5, 13.4 + i / 1000, 40.0 if i < 3 else 0.0, i < 3)) for i in range(4)], "a")
    q = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), StreamConfig(stale_flush_ms=1), processingTime="1 second")
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if q.exception():
                raise q.exception()
            try:
                if [r.end_reason for r in ingest.read_store(spark, str(tmp_path / "out"))[1].collect()] == ["ignition_off"]:
                    break
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "FAILED_READ_FILE" not in str(e) and "does not exist" not in str(e):
                    raise
        else:
            raise AssertionError("nothing was flushed")
    finally:
        q.stop()


def test_repeated_batch_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("point", "d", 1, False, json.dumps(Point(1, 5, 1.0, 2.0, 3.0, True)._asdict()))], ingest.OUTPUT)
    write_batch = ingest.sink(str(tmp_path))
    write_batch(rows, 0)
    write_batch(rows, 0)
    assert ingest.read_store(spark, str(tmp_path))[0].count() == 1


@pytest.mark.parametrize("seed", [42, 1337, 2026])
def test_trips_match_the_truth(spark, seed):
    sent, truth = fleet_frames(spark, Fleet(seed=seed, devices=12, trips=4), Faults(seed=seed + 1))
    from trackloom.operators.ordering import first_arrivals, offered

    fresh = first_arrivals(sent)
    late = offered(fresh, ReorderConfig()).filter("outcome <> 'accepted'").select("device_id", "seq")
    stored = trips.trips(fresh.join(late, ["device_id", "seq"], "left_anti"))
    found = accuracy.comparison(truth.selectExpr("*", "idle_ms / 1000 as idle_s"), stored).first()
    assert found.expected_trips == found.actual_trips == 48 and found.devices_off == 0
    assert found.max_distance_error < 0.01
    duplicates = sent.count() - fresh.count()
    assert duplicates == delivered(simulate(Fleet(seed=seed, devices=12, trips=4))[0], Faults(seed=seed + 1))[1]["duplicates"]


def test_worked_buffers():
    p = lambda s: Point(s, s * 1000, 0.0, 0.0, 0.0, False)
    run = lambda b, *seqs: [(o, [x.seq for x in r]) for o, r in (b.offer(p(s)) for s in seqs)]
    assert run(ReorderBuffer(ReorderConfig(5000)), 10, 9, 15)[-1] == ("accepted", [9, 10])
    b = ReorderBuffer(ReorderConfig(5000))
    b.cursor = 1
    assert run(b, 1, 3, 2) == [("accepted", [1]), ("accepted", []), ("accepted", [2, 3])] and b.cursor == 4
    b = ReorderBuffer(ReorderConfig(5000))
    b.cursor = 1
    assert run(b, 1, 3, 7, 8, 2, 2)[3:] == [("accepted", [3]), ("late", []), ("duplicate", [])]
    b = ReorderBuffer(ReorderConfig(10**9, 3))
    assert run(b, 5, 7, 9, 11)[-1] == ("accepted", [5])
    b = ReorderBuffer(ReorderConfig(10**9))
    run(b, 4, 2, 9)
    assert [x.seq for x in b.flush()] == [2, 4, 9]
    b.cursor = 1
    run(b, 5000)
    b.flush()
    assert sum(y - x + 1 for x, y in b.passed) == 512 and ReorderBuffer.load(b.dump()).dump() == b.dump()
    assert TripConfig().gap_ms == 300_000
