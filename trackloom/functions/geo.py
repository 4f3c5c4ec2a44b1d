"""Spherical geometry as column expressions, with the same formulas for plain numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean earth radius in metres.
EARTH_RADIUS_M = 6_371_008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null if a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    s = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(s > 1, F.lit(1.0)).otherwise(s)))


def destination(lat: Column, lon: Column, bearing_deg: Column, distance_m: Column) -> tuple[Column, Column]:
    """Latitude and longitude (within -180..180) reached from a point on a bearing."""
    angle, course, phi = distance_m / EARTH_RADIUS_M, F.radians(bearing_deg), F.radians(lat)
    sin_to = F.sin(phi) * F.cos(angle) + F.cos(phi) * F.sin(angle) * F.cos(course)
    turn = F.atan2(F.sin(course) * F.sin(angle) * F.cos(phi), F.cos(angle) - F.sin(phi) * sin_to)
    return F.degrees(F.asin(sin_to)), F.pmod(F.degrees(F.radians(lon) + turn) + 540, F.lit(360.0)) - 180


def haversine(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    s = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(s)))


def destination_point(lat: float, lon: float, bearing_deg: float, distance_m: float) -> tuple[float, float]:
    angle, course, phi = distance_m / EARTH_RADIUS_M, math.radians(bearing_deg), math.radians(lat)
    sin_to = math.sin(phi) * math.cos(angle) + math.cos(phi) * math.sin(angle) * math.cos(course)
    turn = math.atan2(math.sin(course) * math.sin(angle) * math.cos(phi), math.cos(angle) - math.sin(phi) * sin_to)
    return math.degrees(math.asin(sin_to)), (math.degrees(math.radians(lon) + turn) + 540) % 360 - 180
