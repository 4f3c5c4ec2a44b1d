"""Streaming ingest: dedup, reordering and trips as keyed state, written once per micro-batch.

A device's state is its reorder buffer, the trip state machine, and which numbers below the cursor have never come, as ranges. So a
message below the cursor is late if it was missing and a duplicate if not, whatever its age, without asking a store. Messages of one key
may come in any order within a micro-batch; they are sorted by ``arrival`` first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trackloom.operators.fold import Point, ReorderBuffer, TripFold
from trackloom.schemas import IDLE_SEGMENTS, TRIPS, StreamConfig
from trackloom.shipping import ship
from trackloom.sources.messages import message_stream, validated

OUTPUT = "kind string, device_id string, seq bigint, late boolean, body string"
DEVICE = "device_id string, state string, last_seq bigint, last_ms bigint, last_lat double, last_lon double, last_speed_kph double, last_ignition boolean, open_trip string, next_seq bigint"
POINT = "device_id string, seq bigint, ts_ms bigint, lat double, lon double, speed_kph double, ignition boolean, late boolean"


class Missing:
    """Numbers below the cursor that have not come, as ascending closed ranges."""

    def __init__(self, ranges: list[list[int]]):
        self.ranges = ranges

    def take(self, n: int) -> bool:
        """Whether ``n`` was missing; it no longer is."""
        for i, (a, b) in enumerate(self.ranges):
            if a <= n <= b:
                self.ranges[i : i + 1] = [r for r in ([a, n - 1], [n + 1, b]) if r[0] <= r[1]]
                return True
        return False

    def add(self, a: int, b: int) -> None:
        if a <= b:
            self.ranges.append([a, b])


class DeviceState:
    def __init__(self, cfg: StreamConfig, text: str | None = None):
        d = json.loads(text) if text else {"buffer": None, "fold": None, "missing": []}
        self.buffer, self.fold, self.missing = ReorderBuffer.load(d["buffer"], cfg.reorder), TripFold.load(d["fold"], cfg.trip), Missing(d["missing"])

    def dump(self) -> str:
        self.buffer.passed = []  # the ranges know more
        return json.dumps({"buffer": self.buffer.dump(), "fold": self.fold.dump(), "missing": self.missing.ranges})

    def _apply(self, released: list[Point], next_before: int | None) -> list[dict]:
        out, expected = [], next_before or 0
        for p in released:
            self.missing.add(expected, p.seq - 1)
            expected = p.seq + 1
            out += self.fold.apply(p)
        return out

    def offer(self, p: Point) -> tuple[bool | None, list[dict]]:
        """Whether a new message is late (None for a duplicate), and the trips it closes."""
        cursor = self.buffer.cursor
        if cursor is not None and p.seq < cursor:
            return (True if self.missing.take(p.seq) else None), []
        outcome, released = self.buffer.offer(p)
        return (False if outcome == "accepted" else None), self._apply(released, cursor)

    def flush(self) -> list[dict]:
        cursor = self.buffer.cursor
        return self._apply(self.buffer.flush(), cursor)

    def row(self) -> str:
        """The device as it is served: state, last applied point, open trip, next number."""
        last, open_trip = self.fold.last, self.fold.open_summary()
        shown = open_trip and dict(zip(("startSeq", "startTs", "distanceM", "pointCount", "idleSegments"), open_trip.values(), strict=True))
        seen = {f"last_{k}": getattr(last, n) for k, n in (("seq", "seq"), ("ms", "ts_ms"), ("lat", "lat"), ("lon", "lon"), ("speed_kph", "speed_kph"), ("ignition", "ignition"))} if last else {}
        return json.dumps({"state": self.fold.state, **seen, "open_trip": shown and json.dumps(shown), "next_seq": self.buffer.cursor})


class DeviceProcessor(StatefulProcessor):
    def __init__(self, cfg: StreamConfig, timers: bool):
        self.cfg, self.timers = cfg, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("device", "text string")

    def _load(self) -> DeviceState:
        return DeviceState(self.cfg, self.state.get()[0] if self.state.exists() else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        device, state, out = key[0], self._load(), []
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        for r in batch.itertuples(index=False):
            p = Point(int(r.seq), int(r.ts_ms), float(r.lat), float(r.lon), float(r.speed_kph), bool(r.ignition))
            late, closed = state.offer(p)
            if late is not None:
                out.append(("point", device, p.seq, late, json.dumps(p._asdict())))
            out += [("trip", device, t["start_seq"], False, json.dumps(t)) for t in closed]
        out.append(("device", device, 0, False, state.row()))
        self.state.update((state.dump(),))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.cfg.stale_flush_ms)
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A device that has been quiet for the stale time gives up all it holds back."""
        state = self._load()
        out = [("trip", key[0], t["start_seq"], False, json.dumps(t)) for t in state.flush()]
        out.append(("device", key[0], 0, False, state.row()))
        self.state.update((state.dump(),))
        yield frame(out)

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "device_id", "seq", "late", "body"]).astype({"seq": "int64", "late": "bool"})


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def tagged(messages: DataFrame, cfg: StreamConfig = StreamConfig(), timers: bool = True) -> DataFrame:
    """Points and closed trips, one kind of row, from a stream of valid messages with ``arrival``."""
    use_state_store(messages.sparkSession)
    ship(messages.sparkSession)
    return messages.groupBy("device_id").transformWithStateInPandas(DeviceProcessor(cfg, timers), outputStructType=OUTPUT, outputMode="append", timeMode="ProcessingTime" if timers else "None")


def points_of(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", "seq bigint, ts_ms bigint, lat double, lon double, speed_kph double, ignition boolean")
    return rows.filter("kind = 'point'").withColumn("b", body).select("device_id", "b.*", "late")


def trips_of(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", TRIPS.replace("device_id string, ", "") + ", segments array<array<bigint>>")
    return rows.filter("kind = 'trip'").withColumn("b", body).select("device_id", "b.*")


def devices_of(rows: DataFrame) -> DataFrame:
    """The state of the devices of a batch; of a device that comes twice the furthest."""
    body = F.from_json("body", DEVICE.replace("device_id string, ", ""))
    found = rows.filter("kind = 'device'").withColumn("b", body).groupBy("device_id").agg(F.max_by("b", F.coalesce("b.next_seq", F.lit(-1))).alias("b"))
    return found.select("device_id", "b.*")


def idle_of(t: DataFrame) -> DataFrame:
    """Idle segments of trips that carry them as ``segments``."""
    s = t.select("device_id", F.col("start_seq").alias("trip_start_seq"), F.explode("segments").alias("s"))
    length = F.greatest(F.col("s")[2] - F.col("s")[1], F.lit(0)) / 1000
    return s.select("device_id", "trip_start_seq", F.col("s")[0].alias("start_seq"), F.col("s")[1].alias("start_ms"), F.col("s")[2].alias("end_ms"), length.alias("duration_s"))


def sink(base: str, on_trips: Callable[[DataFrame, int], None] | None = None):
    """A ``foreachBatch`` function. Each table gets a folder for each batch, which a repeated batch overwrites: rows count once, and no
    stored row is ever read back. ``on_trips`` gets the trips of each batch once they are written."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            t = trips_of(rows)
            for name, df in (("points", points_of(rows)), ("trips", t.drop("segments")), ("idle_segments", idle_of(t)), ("devices", devices_of(rows))):
                df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")
            if on_trips:
                on_trips(t.drop("segments"), batch_id)
        finally:
            rows.unpersist()

    return write


def read_store(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points, trips and idle segments written so far."""
    read = lambda name, schema: spark.read.schema(schema + ", batch bigint").parquet(f"{base}/{name}").drop("batch")
    return read("points", POINT), read("trips", TRIPS), read("idle_segments", IDLE_SEGMENTS)


def read_devices(spark: SparkSession, base: str) -> DataFrame:
    """The latest state of each device; values that a later batch lacks are kept, but for state and open trip."""
    every = spark.read.schema(DEVICE + ", batch bigint").parquet(f"{base}/devices")
    latest = lambda c: F.max_by(c, "batch") if c in ("state", "open_trip") else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch")))
    return every.groupBy("device_id").agg(*(latest(c).alias(c) for c in every.columns if c not in ("device_id", "batch")))


def start(spark: SparkSession, source: str, base: str, checkpoint: str, cfg: StreamConfig = StreamConfig(), partitions: int | None = None, timers: bool = True, on_trips: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Ingest from JSON-line files of envelopes into tables under ``base``; ``trigger`` as for ``writeStream.trigger``.

    A message is acknowledged by the commit of its offsets, which follows the batch's write; backpressure is the number of files a
    trigger takes. Stopping keeps the state and flushes nothing.
    """
    valid = validated(message_stream(spark, source, cfg.max_files_per_trigger), partitions).filter("error is null")
    rows = tagged(valid.select("device_id", "seq", "ts_ms", "lat", "lon", "speed_kph", "ignition", "arrival"), cfg, timers)
    return rows.writeStream.foreachBatch(sink(base, on_trips)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
