"""Queries on neighbours, loop candidates, and dynamic points."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import neighbours as N
from cairn.operators.dynamic import DynamicParams, angular_nearest, update_probabilities

from .views import edges, keyframes, points, r6, with_views

PARAMS = DynamicParams(max_angle=0.1)


def _sides(spark, d):
    """Submaps of even number as the map, odd ones as a scan."""
    p = points(spark, d)
    return p.where("cloud_id % 2 = 0"), p.where("cloud_id % 2 = 1")


def nn_self_excluded(spark, d):
    p = points(spark, d)
    return N.nearest(p, p, 0.5).select("point_id", "match_id", r6("d2").alias("d2"))


def knn_k(spark, d):
    p = points(spark, d)
    return N.knn(p, p, 3, 1.5, by=["cloud_id"]).select(F.col("l.point_id").alias("point_id"), "rank", F.col("r.point_id").alias("match_id"), r6("d2").alias("d2"))


def radius_count(spark, d):
    p = points(spark, d)
    return N.within(p, p, 1.0).where("l.point_id <> r.point_id").groupBy(F.col("l.point_id").alias("point_id")).agg(F.count("*").alias("n"))


def angular_nn(spark, d):
    cloud, scan = _sides(spark, d)
    return angular_nearest(cloud, scan, 0.1).select("point_id", "match_id", r6("d2").alias("d2"))


def novel_split(spark, d):
    cloud, scan = _sides(spark, d)
    near = N.nearest(scan, cloud.unionByName(scan), 0.5).select("point_id", "d2")
    return N.novel_split(scan.join(near, "point_id"), 0.36, 1.0, 0.7).select("point_id", r6("d2").alias("d2"), "novel")


def color_backfill(spark, d):
    cloud, scan = _sides(spark, d)
    cloud = cloud.withColumn("rgb", F.when(F.col("point_id") % 4 < 2, F.lit(0)).otherwise((F.col("point_id") % 256).cast("int")))
    matched = N.nearest_within(scan, cloud, 1.0).withColumn("rgb", (1 + F.col("point_id") % 255).cast("int"))
    return N.color_backfill(cloud, matched).select("point_id", "rgb")


def loop_candidates(spark, d):
    return N.loop_candidates(keyframes(spark, d), 3.0).select("robot_id", "kf_id", "cand_id", r6("d2").alias("d2"))


def loop_best(spark, d):
    """The nearest candidate of each keyframe, if near enough."""
    best = N.loop_candidates(keyframes(spark, d), 3.0).groupBy("robot_id", "kf_id").agg(F.min(F.struct("d2", "cand_id")).alias("b"))
    return best.where("b.d2 < 4").select("robot_id", "kf_id", F.col("b.cand_id").alias("cand_id"), r6("b.d2").alias("d2"))


def proximity_pairs_anti(spark, d):
    return N.proximity_pairs(keyframes(spark, d), edges(spark, d), 2.0).select("robot_id", "src", "dst", r6("d2").alias("d2"))


def dynamic_update(spark, d):
    cloud, scan = _sides(spark, d)
    return update_probabilities(cloud, scan, PARAMS).select("point_id", *[r6(c).alias(c) for c in ("p_static", "p_dynamic", "dynamic_ratio")])


def dynamic_stamps(spark, d):
    """Stamps (here days) of the map's points: those that the scan updated have the scan's."""
    cloud, scan = (side.withColumn("stamp", F.date_add(F.lit("2024-01-01"), days)) for side, days in zip(_sides(spark, d), (F.lit(0), F.lit(3)), strict=True))
    return update_probabilities(cloud, scan, PARAMS).select("point_id", F.date_diff("stamp", F.lit("2024-01-01")).alias("days"), (F.col("dynamic_ratio") > 0).alias("updated"))


def dynamic_ratio_hist(spark, d):
    cloud, scan = _sides(spark, d)
    out = update_probabilities(cloud, scan, PARAMS)
    return out.groupBy(F.least(F.floor(F.round("dynamic_ratio", 6) * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (nn_self_excluded, knn_k, radius_count, angular_nn, novel_split, color_backfill, loop_candidates, loop_best, proximity_pairs_anti, dynamic_update, dynamic_stamps, dynamic_ratio_hist)}

_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_ANGLES = """, angles AS (
  SELECT *, acos(z / r) AS inc, atan2(y, x) AS azi FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM points)
), map AS (FROM angles WHERE cloud_id % 2 = 0), scan AS (FROM angles WHERE cloud_id % 2 = 1), pairs AS (
  SELECT m.point_id, s.point_id AS match_id, (m.inc - s.inc) * (m.inc - s.inc) + (m.azi - s.azi) * (m.azi - s.azi) AS d2 FROM map m JOIN scan s ON true
), best AS (
  SELECT point_id, min((d2, match_id)) AS b FROM pairs WHERE d2 <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY 1
), ang AS (
  SELECT map.*, b[2] AS match_id, b[1] AS d2 FROM map LEFT JOIN best USING (point_id)
)
"""
_LOOPS = """, cand AS (
  SELECT a.robot_id, a.kf_id, b.kf_id AS cand_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
  FROM keyframes a JOIN keyframes b ON a.robot_id = b.robot_id AND b.kf_id + 5 <= a.kf_id AND b.kf_id >= 1
)
"""
_DYN = _ANGLES + """, w AS (
  SELECT a.*, s.r AS sr, sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y) + (s.z - a.z) * (s.z - a.z)) AS delta,
    (0.0001::DOUBLE + 0.9999::DOUBLE * abs(a.nx * a.x + a.ny * a.y + a.nz * a.z) / a.r) * (1 - (0.0001::DOUBLE + 0.9999::DOUBLE * sqrt(a.d2) / 0.1::DOUBLE)) AS c2
  FROM ang a LEFT JOIN scan s ON a.match_id = s.point_id AND a.r < 80
), w2 AS (
  SELECT *, CASE WHEN delta < 0.1::DOUBLE OR r > sr THEN 0.0001::DOUBLE WHEN delta - 0.1::DOUBLE < 0.1::DOUBLE * sr THEN 0.0001::DOUBLE + 0.9999::DOUBLE * (delta - 0.1::DOUBLE) / (0.1::DOUBLE * sr) ELSE 1 END AS wd2,
    CASE WHEN delta < 0.1::DOUBLE THEN 1 WHEN delta - 0.1::DOUBLE < 0.1::DOUBLE * sr THEN 0.0001::DOUBLE + 0.9999::DOUBLE * (1 - (delta - 0.1::DOUBLE) / (0.1::DOUBLE * sr)) ELSE 0.0001::DOUBLE END AS wp2,
    sr IS NOT NULL AND sr + 0.1::DOUBLE + 0.1::DOUBLE * sr >= r AS hit FROM w
), w3 AS (
  SELECT *, CASE WHEN p_dynamic < 0.9 THEN (1 - c2) * p_dynamic + c2 * wd2 * ((1 - 0.99::DOUBLE) * p_static + 0.9::DOUBLE * p_dynamic) ELSE 0.9999::DOUBLE END AS d,
    CASE WHEN p_dynamic < 0.9 THEN (1 - c2) * p_static + c2 * wp2 * (0.99::DOUBLE * p_static + (1 - 0.9::DOUBLE) * p_dynamic) ELSE 0.0001::DOUBLE END AS s FROM w2
), updated AS (
  SELECT point_id, round(CASE WHEN hit THEN s / (d + s) ELSE p_static END, 6) + 0.0 AS p_static, round(CASE WHEN hit THEN d / (d + s) ELSE p_dynamic END, 6) + 0.0 AS p_dynamic,
    round(CASE WHEN hit THEN wd2 ELSE 0 END, 6) + 0.0 AS dynamic_ratio FROM w3
)
"""
SQL = {
    "nn_self_excluded": with_views(f"SELECT point_id, b[2] AS match_id, round(b[1], 6) + 0.0 AS d2 FROM (SELECT a.point_id, min(({_D2}, b.point_id)) AS b FROM points a JOIN points b ON a.point_id <> b.point_id GROUP BY 1)"),
    "knn_k": with_views(f"""SELECT point_id, CAST(rank AS INTEGER) AS rank, match_id, round(d2, 6) + 0.0 AS d2 FROM (
  SELECT a.point_id, b.point_id AS match_id, {_D2} AS d2, row_number() OVER (PARTITION BY a.point_id ORDER BY {_D2}, b.point_id) AS rank
  FROM points a JOIN points b ON a.point_id <> b.point_id AND a.cloud_id = b.cloud_id WHERE {_D2} <= 2.25) WHERE rank <= 3"""),
    "radius_count": with_views(f"SELECT a.point_id, count(*) AS n FROM points a JOIN points b ON a.point_id <> b.point_id WHERE {_D2} <= 1 GROUP BY 1"),
    "angular_nn": with_views(_ANGLES + "SELECT point_id, match_id, round(d2, 6) + 0.0 AS d2 FROM ang"),
    "novel_split": with_views(f"""SELECT point_id, round(d2, 6) + 0.0 AS d2, (d2 > 0.36::DOUBLE AND sqrt(x * x + y * y) > 1) OR (z < -0.7::DOUBLE AND d2 > 0.36::DOUBLE / 5) AS novel
  FROM (SELECT a.point_id, a.x, a.y, a.z, min({_D2}) AS d2 FROM points a JOIN points b ON a.point_id <> b.point_id WHERE a.cloud_id % 2 = 1 GROUP BY ALL)"""),
    "color_backfill": with_views(f""", near AS (
  SELECT a.point_id, min(({_D2}, b.point_id)) AS b FROM points a JOIN points b ON a.cloud_id % 2 = 1 AND b.cloud_id % 2 = 0 WHERE {_D2} <= 1 GROUP BY 1
), last AS (SELECT b[2] AS point_id, max(point_id) AS scan FROM near GROUP BY 1)
SELECT point_id, CAST(CASE WHEN point_id % 4 < 2 THEN CASE WHEN scan IS NULL THEN 0 ELSE 1 + scan % 255 END ELSE point_id % 256 END AS INTEGER) AS rgb
FROM points LEFT JOIN last USING (point_id) WHERE cloud_id % 2 = 0"""),
    "loop_candidates": with_views(_LOOPS + "SELECT robot_id, kf_id, cand_id, round(d2, 6) + 0.0 AS d2 FROM cand WHERE d2 <= 9"),
    "loop_best": with_views(_LOOPS + "SELECT robot_id, kf_id, b[2] AS cand_id, round(b[1], 6) + 0.0 AS d2 FROM (SELECT robot_id, kf_id, min((d2, cand_id)) AS b FROM cand WHERE d2 <= 9 GROUP BY ALL) WHERE b[1] < 4"),
    "proximity_pairs_anti": with_views("""SELECT a.robot_id, a.kf_id AS src, b.kf_id AS dst, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 6) + 0.0 AS d2
  FROM keyframes a JOIN keyframes b ON a.robot_id = b.robot_id AND a.kf_id + 1 < b.kf_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.robot_id = a.robot_id AND e.src = a.kf_id AND e.dst = b.kf_id)"""),
    "dynamic_update": with_views(_DYN + "SELECT * FROM updated"),
    "dynamic_stamps": with_views(_DYN + "SELECT point_id, CASE WHEN dynamic_ratio > 0 THEN 3 ELSE 0 END AS days, dynamic_ratio > 0 AS updated FROM updated"),
    "dynamic_ratio_hist": with_views(_DYN + "SELECT CAST(least(floor(dynamic_ratio * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM updated GROUP BY 1"),
}
