"""Coordinates, distances and centroids as Column expressions; arithmetic only, so all of it stays in generated code."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the coordinate systems and of the Earth.
EARTH_M = 6_371_000.0  # haversine distances
EARTH_DTW_M = 6_371_010.0  # distances of track similarity
AXIS, ECC2 = 6378245.0, 0.00669342162296594323
BD_PI = pi * 3000.0 / 180.0
CHINA_LNG, CHINA_LAT = (72.004, 137.8347), (0.8293, 55.8271)


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance, atan2 form."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    h = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return F.lit(2 * radius) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def haversine_asin(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_DTW_M) -> Column:
    """Great-circle distance, asin form with the argument held below 1."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lng2) - F.radians(lng1)) / 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), u * u + v * v * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)))))


def planar(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.sqrt((lat1 - lat2) * (lat1 - lat2) + (lng1 - lng2) * (lng1 - lng2))


def xyz(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a position in degrees."""
    a, b = F.radians(lat), F.radians(lng)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def lat_lng(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Degrees of a direction, of any length."""
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def centroid(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Aggregates: spherical centroid of a group (mean of unit vectors)."""
    return lat_lng(*[F.avg(c) for c in xyz(lat, lng)])


def outside_china(lat: Column, lng: Column) -> Column:
    return ~(lng.between(*CHINA_LNG) & lat.between(*CHINA_LAT))


def _waves(t: Column, *parts: tuple[float, float]) -> Column:
    out = F.lit(0.0)
    for amplitude, rate in parts:
        out = out + F.sin(t * (pi * rate)) * amplitude
    return out * 2.0 / 3.0


def wgs_to_gcj(lat: Column, lng: Column) -> tuple[Column, Column]:
    """WGS-84 to GCJ-02; unchanged outside China."""
    x, y = lng - 105.0, lat - 35.0
    ripple = _waves(x, (20, 6), (20, 2))
    up = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + ripple + _waves(y, (20, 1), (40, 1 / 3)) + _waves(y, (160, 1 / 12), (320, 1 / 30))
    right = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + ripple + _waves(x, (20, 1), (40, 1 / 3)) + _waves(x, (150, 1 / 12), (300, 1 / 30))
    w = 1 - ECC2 * F.sin(F.radians(lat)) * F.sin(F.radians(lat))
    d_lat = up * 180.0 / (AXIS * (1 - ECC2) / (w * F.sqrt(w)) * pi)
    d_lng = right * 180.0 / (AXIS / F.sqrt(w) * F.cos(F.radians(lat)) * pi)
    out = outside_china(lat, lng)
    return F.when(out, lat).otherwise(lat + d_lat), F.when(out, lng).otherwise(lng + d_lng)


def gcj_to_wgs(lat: Column, lng: Column) -> tuple[Column, Column]:
    """One step of the inverse: twice the position less its transform."""
    a, b = wgs_to_gcj(lat, lng)
    return 2 * lat - a, 2 * lng - b


def gcj_to_bd(lat: Column, lng: Column) -> tuple[Column, Column]:
    r = F.sqrt(lng * lng + lat * lat) + 0.00002 * F.sin(lat * BD_PI)
    t = F.atan2(lat, lng) + 0.000003 * F.cos(lng * BD_PI)
    return r * F.sin(t) + 0.006, r * F.cos(t) + 0.0065


def bd_to_gcj(lat: Column, lng: Column) -> tuple[Column, Column]:
    x, y = lng - 0.0065, lat - 0.006
    r = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * BD_PI)
    t = F.atan2(y, x) - 0.000003 * F.cos(x * BD_PI)
    return r * F.sin(t), r * F.cos(t)


def wgs_to_bd(lat: Column, lng: Column) -> tuple[Column, Column]:
    return gcj_to_bd(*wgs_to_gcj(lat, lng))


def bd_to_wgs(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Rounded to six decimals."""
    a, b = gcj_to_wgs(*bd_to_gcj(lat, lng))
    return F.round(a, 6), F.round(b, 6)
