"""Geodetic conversions as Column expressions. Latitude and longitude are in degrees."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere and ellipsoid of the maps at hand, the rounded pi of the sphere conversion, and the region's bounds.
SPHERE_RADIUS, MERCATOR_RADIUS, ECCENTRICITY2, ROUGH_PI = 6378845.0, 6378245.0, 0.00669342162296594323, 3.14
LON_BOUNDS, LAT_BOUNDS = (72.004, 137.8347), (0.8293, 55.8271)
# Polynomial (1, x, y, xx, yy, xy, sqrt|x|) and harmonics (amplitude, frequency over pi, axis) of the offsets.
LAT_POLYNOMIAL, LON_POLYNOMIAL = (-100.0, 2.0, 3.0, 0.0, 0.2, 0.1, 0.2), (300.0, 1.0, 2.0, 0.1, 0.0, 0.1, 0.1)
HARMONICS = ((20.0, 6.0, "x"), (20.0, 2.0, "x"))
LAT_HARMONICS = ((20.0, 1.0, "y"), (40.0, 1 / 3, "y"), (160.0, 1 / 12, "y"), (320.0, 1 / 30, "y"))
LON_HARMONICS = ((20.0, 1.0, "x"), (40.0, 1 / 3, "x"), (150.0, 1 / 12, "x"), (300.0, 1 / 30, "x"))
BD_PI, BD_SHIFT, BD_WAVE = math.pi * 3000 / 180, (0.0065, 0.006), (0.00002, 0.000003)


def to_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = lat / 180.0 * ROUGH_PI, lon / 180.0 * ROUGH_PI
    return SPHERE_RADIUS * F.cos(a) * F.cos(b), SPHERE_RADIUS * F.cos(a) * F.sin(b), SPHERE_RADIUS * F.sin(a)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    scale = F.cos(lat * math.pi / 180.0)
    return scale * lon * math.pi * MERCATOR_RADIUS / 180.0, scale * MERCATOR_RADIUS * F.log(F.tan((90 + lat) * math.pi / 360.0))


def outside(lat: Column, lon: Column) -> Column:
    return ~lon.between(*LON_BOUNDS) | ~lat.between(*LAT_BOUNDS)


def _offset(x: Column, y: Column, polynomial: Sequence[float], harmonics) -> Column:
    terms = (F.lit(1.0), x, y, x * x, y * y, x * y, F.sqrt(F.abs(x)))
    out = sum((c * t for c, t in zip(polynomial, terms, strict=True) if c), F.lit(0.0))
    for amplitude, frequency, axis in (*HARMONICS, *harmonics):
        out = out + amplitude * 2.0 / 3.0 * F.sin((x if axis == "x" else y) * (frequency * math.pi))
    return out


def wgs_to_mars(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(lat, lon) with the region's offset; unchanged outside of it."""
    x, y = lon - 105.0, lat - 35.0
    angle = lat / 180.0 * math.pi
    w = 1 - ECCENTRICITY2 * F.sin(angle) * F.sin(angle)
    up = _offset(x, y, LAT_POLYNOMIAL, LAT_HARMONICS) * 180.0 / (SPHERE_RADIUS * (1 - ECCENTRICITY2) / (w * F.sqrt(w)) * math.pi)
    across = _offset(x, y, LON_POLYNOMIAL, LON_HARMONICS) * 180.0 / (SPHERE_RADIUS / F.sqrt(w) * F.cos(angle) * math.pi)
    stay = outside(lat, lon)
    return F.when(stay, lat).otherwise(lat + up), F.when(stay, lon).otherwise(lon + across)


def mars_to_wgs(lat: Column, lon: Column) -> tuple[Column, Column]:
    """One step of the inverse: minus the offset at the shifted place."""
    there = wgs_to_mars(lat, lon)
    return 2 * lat - there[0], 2 * lon - there[1]


def _bd(x: Column, y: Column, sign: int) -> tuple[Column, Column]:
    radius = F.sqrt(x * x + y * y) + sign * BD_WAVE[0] * F.sin(y * BD_PI)
    angle = F.atan2(y, x) + sign * BD_WAVE[1] * F.cos(x * BD_PI)
    return radius * F.cos(angle), radius * F.sin(angle)


def mars_to_bd(lat: Column, lon: Column) -> tuple[Column, Column]:
    x, y = _bd(lon, lat, 1)
    return y + BD_SHIFT[1], x + BD_SHIFT[0]


def bd_to_mars(lat: Column, lon: Column) -> tuple[Column, Column]:
    x, y = _bd(lon - BD_SHIFT[0], lat - BD_SHIFT[1], -1)
    return y, x
