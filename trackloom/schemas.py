"""Row types and parameters of the telemetry operators."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

#: Schemas as DDL text.
TELEMETRY = "device_id string, seq bigint, ts_ms bigint, lat double, lon double, speed_kph double, ignition boolean"
ENVELOPE = "topic string, payload string, published_at bigint, arrival bigint"
POINTS = "device_id string, seq bigint, ts_ms bigint, lat double, lon double, speed_kph double, ignition boolean, late boolean, received_at timestamp, stored_at timestamp"
TRIPS = (
    "device_id string, start_seq bigint, end_seq bigint, start_ms bigint, end_ms bigint, start_lat double, start_lon double, end_lat double,"
    "end_lon double, distance_m double, duration_s double, idle_s double, point_count int, max_speed_kph float, end_reason string"
)
IDLE_SEGMENTS = "device_id string, trip_start_seq bigint, start_seq bigint, start_ms bigint, end_ms bigint, duration_s double"


@dataclass(frozen=True)
class TripConfig:
    """Thresholds of the trip state machine; the defaults are the reference values."""

    moving_kph: float = 3.0
    gap_ms: int = 300_000
    min_idle_ms: int = 60_000
    max_idle_ms: int = 1_800_000


@dataclass(frozen=True)
class ReorderConfig:
    window_ms: int = 30_000
    max_buffered: int = 500
    #: Released holes a buffer remembers, so that a straggler is called late and not a duplicate.
    holes: int = 512


@dataclass(frozen=True)
class StreamConfig:
    trip: TripConfig = TripConfig()
    reorder: ReorderConfig = ReorderConfig()
    stale_flush_ms: int = 15_000
    max_files_per_trigger: int = 100


def number_setting(env: Mapping[str, str], name: str, default: float) -> float:
    """A numeric setting: unset or blank gives the default, anything not a finite number is an error."""
    raw = env.get(name, "").strip()
    if not raw:
        return default
    try:
        value = float(raw)
    except ValueError:
        value = math.nan
    if not math.isfinite(value):
        raise ValueError(f"{name} must be a number, got {raw!r}")
    return value


def stream_config(env: Mapping[str, str]) -> StreamConfig:
    """Settings by name, for example ``MOVING_KPH`` or ``REORDER_WINDOW_MS``."""
    d = StreamConfig()
    return StreamConfig(
        TripConfig(number_setting(env, "MOVING_KPH", d.trip.moving_kph), int(number_setting(env, "GAP_MS", d.trip.gap_ms)), int(number_setting(env, "MIN_IDLE_MS", d.trip.min_idle_ms)), int(number_setting(env, "MAX_IDLE_MS", d.trip.max_idle_ms))),
        ReorderConfig(int(number_setting(env, "REORDER_WINDOW_MS", d.reorder.window_ms))),
        int(number_setting(env, "STALE_FLUSH_MS", d.stale_flush_ms)),
    )
