"""Rounding, quantiles and formats that must agree with the reference's arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """To an integer with halves upwards, also below zero."""
    return F.floor(x + 0.5)


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def quantile_at(name: str, p: float) -> Column:
    """Nearest-rank quantile: the value at position ceil(p n) of the sorted column; the lower median for one half."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{name}`)")


def duration_text(seconds: Column) -> Column:
    """``1 h 05 min`` from an hour on, else ``5 min`` or ``42 s``."""
    s = round_half_up(seconds)
    hours, minutes = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(s >= 3600, F.format_string("%d h %02d min", hours, minutes)).when(s >= 60, F.format_string("%d min", minutes)).otherwise(F.format_string("%d s", s))


def iso_utc(ms: Column) -> Column:
    """ISO 8601 text with milliseconds in UTC, whatever the session's zone."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
