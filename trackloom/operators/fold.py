"""The trip state machine and the reorder buffer point by point, for keyed streaming state and as a check of the window form."""

from __future__ import annotations

import bisect
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

from trackloom.functions.geo import haversine
from trackloom.schemas import ReorderConfig, TripConfig


class Point(NamedTuple):
    seq: int
    ts_ms: int
    lat: float
    lon: float
    speed_kph: float
    ignition: bool


@dataclass
class Idling:
    seq: int
    ts_ms: int
    lat: float
    lon: float
    distance_m: float


@dataclass
class Journey:
    """A trip under way."""

    start_seq: int
    start_ms: int
    start_lat: float
    start_lon: float
    distance_m: float
    max_speed_kph: float
    point_count: int = 1
    segments: list[tuple[int, int, int]] = field(default_factory=list)
    idling: Idling | None = None

    def finished(self, seq: int, ts_ms: int, lat: float, lon: float, distance_m: float, reason: str) -> dict:
        return {
            "start_seq": self.start_seq, "end_seq": seq, "start_ms": self.start_ms, "end_ms": ts_ms, "start_lat": self.start_lat, "start_lon": self.start_lon,
            "end_lat": lat, "end_lon": lon, "distance_m": distance_m, "duration_s": max(0, ts_ms - self.start_ms) / 1000,
            "idle_s": sum(max(0, e - s) for _, s, e in self.segments) / 1000, "point_count": self.point_count, "max_speed_kph": self.max_speed_kph,
            "end_reason": reason, "segments": list(self.segments),
        }


class TripFold:
    """Feed points of one device in ascending sequence order; ``apply`` gives the trips that a point closes."""

    def __init__(self, cfg: TripConfig = TripConfig()):
        self.cfg = cfg
        self.state = "parked"
        self.last: Point | None = None
        self.place: tuple[float, float] | None = None  # where the next trip is measured from
        self.journey: Journey | None = None

    def apply(self, p: Point) -> list[dict]:
        out, j, cfg = [], self.journey, self.cfg
        if self.last and p.ts_ms - self.last.ts_ms > cfg.gap_ms and j:
            e = self.last
            out.append(j.finished(e.seq, e.ts_ms, e.lat, e.lon, j.distance_m, "gap"))
            self.journey = j = self.last = self.place = None
            self.state = "trip_ended"
        moving = p.ignition and p.speed_kph >= cfg.moving_kph
        if j is None:
            if moving:
                at = self.place or (self.last and (self.last.lat, self.last.lon))
                self.journey = Journey(p.seq, p.ts_ms, *(at or (p.lat, p.lon)), haversine(*at, p.lat, p.lon) if at else 0.0, p.speed_kph)
                self.place, self.state = None, "moving"
            else:
                if not p.ignition or self.place is None:
                    self.place = (p.lat, p.lon)
                self.state = "parked"
        elif (i := j.idling) and p.ignition and not moving and p.ts_ms - i.ts_ms >= cfg.max_idle_ms:
            out.append(j.finished(i.seq, i.ts_ms, i.lat, i.lon, i.distance_m, "idle_timeout"))
            self.journey, self.place, self.state = None, (i.lat, i.lon), "trip_ended"
        else:
            j.distance_m += haversine(self.last.lat, self.last.lon, p.lat, p.lon) if self.last else 0.0
            j.point_count += 1
            j.max_speed_kph = max(j.max_speed_kph, p.speed_kph)
            if p.ignition and not moving:
                j.idling = j.idling or Idling(p.seq, p.ts_ms, p.lat, p.lon, j.distance_m)
                self.state = "idle"
            else:
                if i and max(0, p.ts_ms - i.ts_ms) >= cfg.min_idle_ms:
                    j.segments.append((i.seq, i.ts_ms, p.ts_ms))
                j.idling, self.state = None, "moving"
                if not p.ignition:
                    out.append(j.finished(p.seq, p.ts_ms, p.lat, p.lon, j.distance_m, "ignition_off"))
                    self.journey, self.place, self.state = None, (p.lat, p.lon), "trip_ended"
        self.last = p
        return out

    def replay(self, points: Iterable[Point]) -> list[dict]:
        return [t for p in points for t in self.apply(p)]

    def open_summary(self) -> dict | None:
        j = self.journey
        return j and {"start_seq": j.start_seq, "start_ms": j.start_ms, "distance_m": j.distance_m, "point_count": j.point_count, "idle_segments": len(j.segments)}

    def dump(self) -> str:
        return json.dumps({"state": self.state, "last": self.last, "place": self.place, "journey": self.journey and asdict(self.journey)})

    @classmethod
    def load(cls, text: str | None, cfg: TripConfig = TripConfig()) -> TripFold:
        fold = cls(cfg)
        if text:
            d = json.loads(text)
            fold.state, fold.last, fold.place = d["state"], d["last"] and Point(*d["last"]), d["place"] and tuple(d["place"])
            if j := d["journey"]:
                fold.journey = Journey(**j | {"segments": [tuple(s) for s in j["segments"]], "idling": j["idling"] and Idling(**j["idling"])})
        return fold


class ReorderBuffer:
    """Puts one device's messages back in sequence order; gives up on a hole by event time, by number buffered, or when flushed.

    Rules: a message is due if it is the next number, if the newest event time is a window ahead of its own, or if more than
    ``max_buffered`` wait from it on. The lowest waiting message is released while it is due. What is passed over is remembered as ranges, of
    which the lowest numbers beyond ``holes`` of them are forgotten.
    """

    def __init__(self, cfg: ReorderConfig = ReorderConfig()):
        self.cfg = cfg
        self.cursor: int | None = None  # the next sequence number expected
        self.newest = 0
        self.held: dict[int, Point] = {}
        self.order: list[int] = []  # a heap of the held numbers
        self.passed: list[list[int]] = []  # ascending ranges of numbers, ends included

    def offer(self, p: Point) -> tuple[str, list[Point]]:
        """accepted, duplicate or late; and the points that this releases."""
        if p.seq in self.held:
            return "duplicate", []
        if self.cursor is not None and p.seq < self.cursor:
            return ("late" if self._found(p.seq) else "duplicate"), []
        self.held[p.seq] = p
        heapq.heappush(self.order, p.seq)
        self.newest = max(self.newest, p.ts_ms)
        return "accepted", list(self._released(self._due))

    def flush(self) -> list[Point]:
        return list(self._released(lambda p: True))

    def _due(self, p: Point) -> bool:
        return p.seq == self.cursor or self.newest - p.ts_ms >= self.cfg.window_ms or len(self.held) > self.cfg.max_buffered

    def _released(self, due: Callable[[Point], bool]) -> Iterator[Point]:
        while self.order and due(self.held[self.order[0]]):
            p = self.held.pop(heapq.heappop(self.order))
            if self.cursor is not None and p.seq > self.cursor:
                self._pass_over(self.cursor, p.seq - 1)
            self.cursor = p.seq + 1
            yield p

    def _pass_over(self, low: int, high: int) -> None:
        self.passed.append([low, high])
        excess = sum(b - a + 1 for a, b in self.passed) - self.cfg.holes
        while excess > 0:
            a, b = self.passed[0]
            gone = min(excess, b - a + 1)
            self.passed[:1] = [[a + gone, b]] if a + gone <= b else []
            excess -= gone

    def _found(self, n: int) -> bool:
        """Whether ``n`` was passed over; it is then no longer."""
        at = bisect.bisect_right(self.passed, n, key=lambda r: r[0]) - 1
        if at < 0 or self.passed[at][1] < n:
            return False
        a, b = self.passed[at]
        self.passed[at : at + 1] = [r for r in ([a, n - 1], [n + 1, b]) if r[0] <= r[1]]
        return True

    def dump(self) -> str:
        return json.dumps([self.cursor, self.newest, [self.held[n] for n in sorted(self.held)], self.passed])

    @classmethod
    def load(cls, text: str | None, cfg: ReorderConfig = ReorderConfig()) -> ReorderBuffer:
        buffer = cls(cfg)
        if text:
            buffer.cursor, buffer.newest, waiting, buffer.passed = json.loads(text)
            buffer.held = {x[0]: Point(*x) for x in waiting}
            buffer.order = sorted(buffer.held)
        return buffer
