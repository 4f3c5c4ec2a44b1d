"""Publishing, ingest, snapshots and verdict end to end; progress samples; resetting."""

from pyspark.sql import functions as F

from trackloom.plans import serving, snapshots
from trackloom.sources.publisher import publish
from trackloom.sources.simulator import Faults, Fleet, fleet_frames
from trackloom.schemas import StreamConfig
from trackloom.streaming import ingest
from trackloom.streaming.progress import ProgressSamples


def test_published_fleet_is_stored_once(spark, tmp_path):
    sent, truth = fleet_frames(spark, Fleet(seed=5, devices=3, trips=2), Faults(seed=6, late=0.01))
    path = str(tmp_path / "in")
    publish(sent, path, files=3, partitions=8)
    heard, closed = ProgressSamples(), []
    spark.streams.addListener(heard)
    try:
        ingest.start(spark, path, str(tmp_path / "out"), str(tmp_path / "state"), StreamConfig(max_files_per_trigger=1), partitions=8, timers=False, on_trips=lambda t, b: closed.extend((r.device_id, r.start_seq) for r in t.collect()), availableNow=True).awaitTermination()
    finally:
        spark.streams.removeListener(heard)
    points, trips, idle = ingest.read_store(spark, str(tmp_path / "out"))
    run = snapshots.snapshot(points, trips, idle)
    found = snapshots.report(sent, run, run).first()
    assert found.ok and found.expected == found.stored and found.lost == 0
    assert sorted(closed) == sorted((r.device_id, r.start_seq) for r in trips.collect()) and 3 <= len(closed) <= truth.count()
    lost_trip = snapshots.snapshot(points, trips.limit(trips.count() - 1), idle)
    assert not snapshots.report(sent, lost_trip, run).first().ok
    assert run.trips.first().start_ms.endswith("Z")
    some = snapshots.of_partitions(points, 8, [0, 1, 2, 3])
    assert some.count() + snapshots.of_partitions(points, 8, [4, 5, 6, 7]).count() == points.count()
    # what the buffers hold back at the end is all that a replay could add
    held = serving.recovered_trips(points, trips)
    assert held.count() <= 3
    assert held.join(trips, ["device_id", "start_seq"], "left_semi").isEmpty()
    snapshots.write_results(trips.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "result"))
    assert spark.read.json(str(tmp_path / "result")).first().n == len(closed)
    if heard.rows:
        assert heard.samples(spark).filter("metric = 'fleet_ingest_received_rows'").agg(F.sum("value")).first()[0] > 0
    snapshots.reset(spark, str(tmp_path / "out"), ingest.POINT)
    assert spark.read.schema(ingest.POINT).parquet(str(tmp_path / "out/points")).count() == 0
