"""Distances on the sphere and the state's bounding box."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's radius in miles, and the box that coordinates must lie in (lowest and highest latitude and longitude).
EARTH_MILES = 3958.8
TEXAS = (25.84, 36.50, -106.65, -93.51)
MILES_PER_DEGREE = 69.09


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Miles between two points."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return EARTH_MILES * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def box(lat: float, lng: float, miles: float) -> tuple[float, float, float, float]:
    """A box around a point that holds everything within ``miles``: the longitude step uses the latitude furthest from the equator."""
    dlat = 1.01 * miles / MILES_PER_DEGREE
    dlng = dlat / max(math.cos(math.radians(min(89.0, abs(lat) + dlat))), 1e-6)
    return lat - dlat, lat + dlat, lng - dlng, lng + dlng


def in_texas(lat: Column, lng: Column) -> Column:
    return lat.between(*TEXAS[:2]) & lng.between(*TEXAS[2:])
