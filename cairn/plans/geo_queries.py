"""Geodesy queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geodesy as g

from .views import r6, wgs, with_views

def _query(convert, names, digits=6):
    """Metres are rounded more than degrees: their last digits differ between mathematical libraries."""
    return lambda spark, d: wgs(spark, d).select("id", *[(F.round(c, digits) + 0.0).alias(n) for c, n in zip(convert(F.col("lat"), F.col("lon")), names, strict=True)])


def _there_and_back(spark, d):
    there = wgs(spark, d).select("id", *[c.alias(n) for c, n in zip(g.mars_to_bd(F.col("lat"), F.col("lon")), ("lat", "lon"), strict=True)])
    return there.select("id", *[r6(c).alias(n) for c, n in zip(g.bd_to_mars(F.col("lat"), F.col("lon")), ("lat", "lon"), strict=True)])


QUERIES = {
    "gps_to_xyz": _query(g.to_sphere, ("x", "y", "z"), 2),
    "mercator": _query(g.mercator, ("x", "y"), 2),
    "wgs_to_mars": _query(g.wgs_to_mars, ("lat", "lon")),
    "mars_to_real": _query(g.mars_to_wgs, ("lat", "lon")),
    "bd_encrypt": _query(g.mars_to_bd, ("lat", "lon")),
    "bd_decrypt": _there_and_back,
}

_MARS = """, shifted AS (
  SELECT *, lon - 105.0 AS x, lat - 35.0 AS y, lat / 180.0 * pi() AS a FROM wgs
), offsets AS (
  SELECT *, 1 - 0.00669342162296594323::DOUBLE * sin(a) * sin(a) AS w, (20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3 AS common,
    -100.0::DOUBLE + 2 * x + 3 * y + 0.2::DOUBLE * y * y + 0.1::DOUBLE * x * y + 0.2::DOUBLE * sqrt(abs(x)) AS lat0,
    300.0::DOUBLE + x + 2 * y + 0.1::DOUBLE * x * x + 0.1::DOUBLE * x * y + 0.1::DOUBLE * sqrt(abs(x)) AS lon0,
    (20 * sin(y * pi()) + 40 * sin(y / 3 * pi()) + 160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3 AS lat1,
    (20 * sin(x * pi()) + 40 * sin(x / 3 * pi()) + 150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3 AS lon1
  FROM shifted
), mars AS (
  SELECT id, lat, lon,
    CASE WHEN lon < 72.004 OR lon > 137.8347 OR lat < 0.8293 OR lat > 55.8271 THEN 0.0::DOUBLE
         ELSE (lat0 + common + lat1) * 180 / (6378845.0::DOUBLE * (1 - 0.00669342162296594323::DOUBLE) / (w * sqrt(w)) * pi()) END AS up,
    CASE WHEN lon < 72.004 OR lon > 137.8347 OR lat < 0.8293 OR lat > 55.8271 THEN 0.0::DOUBLE
         ELSE (lon0 + common + lon1) * 180 / (6378845.0::DOUBLE / sqrt(w) * cos(a) * pi()) END AS across
  FROM offsets
)
"""
_BD = """, bd AS (
  SELECT id, (sqrt(lon * lon + lat * lat) + 0.00002::DOUBLE * sin(lat * pi() * 3000 / 180)) AS z, atan2(lat, lon) + 0.000003::DOUBLE * cos(lon * pi() * 3000 / 180) AS t FROM wgs
), bds AS (SELECT id, z * sin(t) + 0.006::DOUBLE AS lat, z * cos(t) + 0.0065::DOUBLE AS lon FROM bd)
"""
SQL = {
    "gps_to_xyz": with_views("""SELECT id, round(6378845.0::DOUBLE * cos(lat / 180 * 3.14::DOUBLE) * cos(lon / 180 * 3.14::DOUBLE), 2) + 0.0 AS x,
       round(6378845.0::DOUBLE * cos(lat / 180 * 3.14::DOUBLE) * sin(lon / 180 * 3.14::DOUBLE), 2) + 0.0 AS y, round(6378845.0::DOUBLE * sin(lat / 180 * 3.14::DOUBLE), 2) + 0.0 AS z FROM wgs"""),
    "mercator": with_views("""SELECT id, round(cos(lat * pi() / 180) * lon * pi() * 6378245.0::DOUBLE / 180, 2) + 0.0 AS x,
       round(cos(lat * pi() / 180) * 6378245.0::DOUBLE * ln(tan((90 + lat) * pi() / 360)), 2) + 0.0 AS y FROM wgs"""),
    "wgs_to_mars": with_views(_MARS + "SELECT id, round(lat + up, 6) + 0.0 AS lat, round(lon + across, 6) + 0.0 AS lon FROM mars"),
    "mars_to_real": with_views(_MARS + "SELECT id, round(lat - up, 6) + 0.0 AS lat, round(lon - across, 6) + 0.0 AS lon FROM mars"),
    "bd_encrypt": with_views(_BD + "SELECT id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM bds"),
    "bd_decrypt": with_views(_BD + """, back AS (
  SELECT id, sqrt(x * x + y * y) - 0.00002::DOUBLE * sin(y * pi() * 3000 / 180) AS z, atan2(y, x) - 0.000003::DOUBLE * cos(x * pi() * 3000 / 180) AS t
  FROM (SELECT id, lon - 0.0065::DOUBLE AS x, lat - 0.006::DOUBLE AS y FROM bds))
SELECT id, round(z * sin(t), 6) + 0.0 AS lat, round(z * cos(t), 6) + 0.0 AS lon FROM back"""),
}
