"""Great-circle distance and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres.
EARTH = 6371008.7714


def check_point(lat: float, lon: float) -> None:
    if not -90 <= lat <= 90:
        raise ValueError(f"latitude {lat} is not in [-90, 90]")
    if not -180 <= lon <= 180:
        raise ValueError(f"longitude {lon} is not in [-180, 180]")


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    a, b = F.radians(lat), F.radians(F.lit(lat0))
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(F.lit(lon0)) - F.radians(lon)) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def within(point: Column, lat: float, lon: float, meters: float) -> Column:
    """Distance, behind a band of latitudes that a scan can check with less work."""
    check_point(lat, lon)
    if not meters > 0:
        raise ValueError("distance must be positive")
    band = meters / 111_000 + 0.01
    near = point["lat"].between(lat - band, lat + band)
    return near & (haversine(point["lat"], point["lon"], lat, lon) <= meters)


def in_box(point: Column, top: float, left: float, bottom: float, right: float) -> Column:
    check_point(top, left)
    check_point(bottom, right)
    if bottom > top:
        raise ValueError("bottom is above top")
    lon = point["lon"]
    across = (lon >= left) | (lon <= right) if left > right else lon.between(left, right)
    return point["lat"].between(bottom, top) & across
