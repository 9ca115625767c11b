"""Column builders for plane and geodetic geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in metres, and metres of a degree of latitude and of longitude at the equator.
EARTH_M, LAT_M, LON_M = 6_371_000.0, 111_132.0, 111_320.0


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geodetic_area(area_deg2: Column, lat: Column) -> Column:
    """Square degrees at a latitude as square metres."""
    return area_deg2 * LAT_M * LON_M * F.cos(F.radians(lat))


def bezier(t: Column, a: Column, c: Column, b: Column) -> Column:
    """Point at t of the quadratic curve from a to b with control c (one coordinate)."""
    s = F.lit(1.0) - t
    return s * s * a + F.lit(2.0) * s * t * c + t * t * b
