"""Distances and planar positions on lines, in degrees of latitude and longitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def along(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Fraction 0..1 of the piece a→b that is nearest to the point, in the plane."""
    d_lat, d_lon = b_lat - a_lat, b_lon - a_lon
    length2 = d_lat * d_lat + d_lon * d_lon
    t = ((lat - a_lat) * d_lat + (lon - a_lon) * d_lon) / F.nullif(length2, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def zone_box(lat: Column, lon: Column, d_lat: float = 0.15, d_lon: float = 0.20) -> Column:
    """Four corners around a point, clockwise from the north-west."""
    corner = [(d_lat, -d_lon), (d_lat, d_lon), (-d_lat, d_lon), (-d_lat, -d_lon)]
    return F.array(*[F.struct((lat + y).alias("lat"), (lon + x).alias("lon")) for y, x in corner])
