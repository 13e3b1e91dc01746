"""Queries on fixes, stamps, pose rules, and small graph edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.operators import clouds, fixes, graph, neighbours, registration

from .views import PLANAR_SQL, edges, gps, imu, keyframes, planar, planar_product, planar_relative, points, r6, scan_frames, tf, with_views


def gps_normalize(spark, d):
    f = gps(spark, d).select("robot_id", "stamp", (F.col("easting") / 10).alias("longitude"), (F.col("northing") / 10).alias("latitude"), F.lit(1.0).alias("altitude"), (F.col("event_id") % 3).cast("int").alias("status"))
    return fixes.normalize_fix(f).select("robot_id", "stamp", r6("longitude").alias("longitude"), r6("latitude").alias("latitude"), "northing", "easting", "status", "satellites_used")


def gps_halves(spark, d):
    out = fixes.merge_halves(gps(spark, d), imu(spark, d).withColumn("yaw", F.col("gz") * 10))
    return out.select("robot_id", "event_id", r6("easting").alias("easting"), r6("northing").alias("northing"), r6("yaw").alias("yaw"))


def timestamp_split(spark, d):
    return scan_frames(spark, d).select("robot_id", "frame_id", *[c.alias(n) for c, n in zip(fixes.split_stamp(), ("msec", "sec", "nsec"), strict=True)])


def wrap_angles(spark, d):
    return imu(spark, d).select("robot_id", "event_id", r6(P.wrap_angle(F.col("gz") * 200)).alias("angle"))


def rpy_matrix(spark, d):
    m = imu(spark, d).withColumn("m", P.from_roll_pitch_yaw(F.col("gz") * 10, F.col("ax") / 10, F.col("gz") * 20))
    return m.select("robot_id", "event_id", *[r6(F.col("m")[i]).alias(f"m{i}") for i in (0, 1, 2, 4, 8, 10)])


def quaternion_roundtrip(spark, d):
    m = imu(spark, d).withColumn("m", P.from_roll_pitch_yaw(F.col("gz") * 10, F.col("ax") / 10, F.col("gz") * 20))
    q = m.withColumn("q", P.to_quaternion(F.col("m")))
    return q.select("robot_id", "event_id", r6(F.col("q.w") * F.col("q.w") + F.col("q.x") * F.col("q.x") + F.col("q.y") * F.col("q.y") + F.col("q.z") * F.col("q.z")).alias("length2"), (F.col("q.w") >= 0).alias("positive"))


def guess_clamp(spark, d):
    t = tf(spark, d).withColumn("z", F.col("tx") / 10 - 12)
    return t.select("robot_id", "event_id", *[r6(fixes.clamp_guess(F.col("z"), n)).alias(n) for n in ("loop", "batch", "flat")])


def loop_overlap_best(spark, d):
    """Loop candidate of largest overlap (here 1 / (1 + d2)) for each keyframe, rejected below 0.4."""
    c = neighbours.loop_candidates(keyframes(spark, d), 3.0).withColumn("overlap", 1 / (1 + F.col("d2")))
    best = c.groupBy("robot_id", "kf_id").agg(F.max_by(F.struct("cand_id", "overlap"), F.struct("overlap", -F.col("cand_id"))).alias("b"))
    return best.where("b.overlap >= 0.4").select("robot_id", "kf_id", F.col("b.cand_id").alias("cand_id"), r6("b.overlap").alias("overlap"))


def sample_neighbours(spark, d):
    """Two neighbours of each node, chosen by hash."""
    by = Window.partitionBy("robot_id", "src").orderBy(clouds.uniform(F.col("dst"), 5), "dst")
    e = graph.insert_absent(edges(spark, d), edges(spark, d).select("robot_id", "src", (F.col("dst") + 2).alias("dst"), "pose", "reachable"))
    return e.withColumn("n", F.row_number().over(by)).where("n <= 2").select("robot_id", "src", "dst")


def reslam_anchor(spark, d):
    """A new session's first keyframe linked to the newest old one by an identity, both ways reachable."""
    last = keyframes(spark, d).groupBy("robot_id").agg(F.max("kf_id").alias("old")).withColumn("new", F.col("old") + 1)
    return graph.anchor_session(last).select("robot_id", "src", "dst", *planar(), "reachable")


def orthonormalize(spark, d):
    """Rotations that rounding has stretched, made exact again."""
    p = F.transform(P.from_yaw(F.col("yaw"), F.col("x"), F.col("y")), lambda v, i: F.when((i % 4 < 3) & (i < 11), v * 1.01).otherwise(v))
    return keyframes(spark, d).select("robot_id", "kf_id", *planar(P.orthonormalize(p)))


def nav_state(spark, d):
    """Bodies' poses and velocities from those of the laser, and the laser's back from them."""
    mount = P.from_yaw(F.lit(0.2), F.lit(0.5), F.lit(0.1))
    laser = P.from_yaw(F.col("yaw"), F.col("x"), F.col("y"))
    body = P.nav_of_laser(laser, mount)
    v = P.turn_velocity(P.identity(), body, [F.lit(1.0), F.lit(0.0), F.lit(0.0)])
    rows = keyframes(spark, d).select("robot_id", "kf_id", body.alias("body"), P.laser_of_nav(body, mount).alias("laser"), v[0].alias("vx"), v[1].alias("vy"))
    return rows.select("robot_id", "kf_id", *planar(F.col("body")), r6("vx").alias("vx"), r6("vy").alias("vy"), r6(F.col("laser")[3]).alias("laser_x"))


def batch_loop_closure(spark, d):
    """Submaps against copies that lie farther off for higher ids, from guesses at their places: those that register near their guess stay."""
    p = points(spark, d).withColumn("pair", F.col("cloud_id"))
    moved = clouds.move(p, P.from_yaw(F.lit(0.01), 0.02 * F.col("cloud_id"), F.lit(0.0), F.lit(0.0)), normals=True)
    pairs = p.select("pair").distinct().withColumn("start", P.identity())
    kept = fixes.batch_loop_closure(pairs, registration.register_pairs(moved, p, starts=pairs), most_shift=0.11)
    return kept.select("pair", *[(F.round(F.col("t")[i], 3) + 0.0).alias(n) for i, n in ((3, "x"), (7, "y"), (0, "c"), (4, "s"))])


def satellite_fixes(spark, d):
    """Full fixes with the latest heading of an inertial system."""
    full = gps(spark, d).select("robot_id", "event_id", "stamp", F.col("easting").alias("longitude"), F.col("northing").alias("latitude"), F.lit(1.0).alias("altitude"), F.lit(0.1).alias("roll"), F.lit(0.2).alias("pitch"), F.lit(7).alias("satellites_used"))
    return fixes.satellite_fix(full, tf(spark, d).withColumnRenamed("tx", "yaw")).select("robot_id", "event_id", r6("longitude").alias("longitude"), "easting", r6("yaw").alias("yaw"), "satellites_used")


QUERIES = {f.__name__: f for f in (orthonormalize, nav_state, gps_normalize, gps_halves, timestamp_split, wrap_angles, rpy_matrix, quaternion_roundtrip, guess_clamp, loop_overlap_best, sample_neighbours, reslam_anchor, batch_loop_closure, satellite_fixes)}

_RPY = ", m AS (SELECT robot_id, event_id, gz * 10 AS r, ax / 10 AS p, gz * 20 AS y FROM imu)"
SQL = {
    "batch_loop_closure": with_views("""SELECT DISTINCT cloud_id AS pair, round(-0.02::DOUBLE * cloud_id * cos(0.01::DOUBLE), 3) + 0.0 AS x, round(0.02::DOUBLE * cloud_id * sin(0.01::DOUBLE), 3) + 0.0 AS y,
  round(cos(0.01::DOUBLE), 3) AS c, round(-sin(0.01::DOUBLE), 3) AS s FROM points WHERE cloud_id <= 5"""),
    "satellite_fixes": with_views("""SELECT g.robot_id, g.event_id, round(easting, 6) + 0.0 AS longitude, 0.0::DOUBLE AS easting, round(tx, 6) + 0.0 AS yaw, 7 AS satellites_used
  FROM gps g ASOF LEFT JOIN tf t ON g.robot_id = t.robot_id AND g.stamp >= t.stamp"""),
    "orthonormalize": with_views(f""", cells AS (SELECT robot_id, kf_id, x, y, cos(yaw) AS c, 1.01::DOUBLE * cos(yaw) AS kc, 1.01::DOUBLE * sin(yaw) AS ks, 1.01::DOUBLE AS k FROM keyframes
), big AS (SELECT *, sqrt(1 + k + 2 * abs(kc)) / 2 AS b FROM cells
), exact AS (SELECT robot_id, kf_id, x, y, 2 * CASE WHEN c >= 0 THEN atan2(ks / (2 * b), b) ELSE atan2(b, ks / (2 * b)) END AS yaw FROM big)
SELECT robot_id, kf_id, {PLANAR_SQL} FROM exact"""),
    "nav_state": with_views(f""", e AS (SELECT 0.5::DOUBLE AS x, 0.1::DOUBLE AS y, 0.2::DOUBLE AS yaw), o AS (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS yaw), back AS (SELECT {planar_relative("e", "o")} FROM e, o
), body AS (SELECT k.robot_id, k.kf_id, k.x AS laser_x, {planar_product("k", "b")} FROM keyframes k, back b)
SELECT robot_id, kf_id, {PLANAR_SQL}, round(cos(yaw), 6) + 0.0 AS vx, round(sin(yaw), 6) + 0.0 AS vy, round(laser_x, 6) + 0.0 AS laser_x FROM body"""),
    "gps_normalize": with_views("SELECT robot_id, stamp, round(easting / 10, 6) + 0.0 AS longitude, round(northing / 10, 6) + 0.0 AS latitude, 0.0::DOUBLE AS northing, 0.0::DOUBLE AS easting, CAST(event_id % 3 AS INTEGER) AS status, CAST(event_id % 3 AS INTEGER) AS satellites_used FROM gps"),
    "gps_halves": with_views(""", halves AS (
  SELECT robot_id, stamp, event_id, easting, northing, NULL::DOUBLE AS yaw FROM gps UNION ALL SELECT robot_id, stamp, event_id, NULL, NULL, gz * 10 FROM imu)
SELECT robot_id, event_id, round(last_value(easting IGNORE NULLS) OVER w, 6) + 0.0 AS easting, round(last_value(northing IGNORE NULLS) OVER w, 6) + 0.0 AS northing, round(last_value(yaw IGNORE NULLS) OVER w, 6) + 0.0 AS yaw
FROM halves WINDOW w AS (PARTITION BY robot_id ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING)"""),
    "timestamp_split": with_views("SELECT robot_id, frame_id, t // 1000000000000 AS msec, t // 1000000 % 1000000 AS sec, t % 1000000 * 1000 AS nsec FROM (SELECT robot_id, frame_id, epoch_us(stamp) AS t FROM scan_frames)"),
    "wrap_angles": with_views("SELECT robot_id, event_id, round(gz * 200 + 3.1416::DOUBLE - 6.2832::DOUBLE * floor((gz * 200 + 3.1416::DOUBLE) / 6.2832::DOUBLE) - 3.1416::DOUBLE, 6) + 0.0 AS angle FROM imu"),
    "rpy_matrix": with_views(_RPY + """ SELECT robot_id, event_id, round(cos(y) * cos(p), 6) + 0.0 AS m0, round(cos(y) * sin(p) * sin(r) - sin(y) * cos(r), 6) + 0.0 AS m1, round(cos(y) * sin(p) * cos(r) + sin(y) * sin(r), 6) + 0.0 AS m2,
  round(sin(y) * cos(p), 6) + 0.0 AS m4, round(-sin(p), 6) + 0.0 AS m8, round(cos(p) * cos(r), 6) + 0.0 AS m10 FROM m"""),
    "quaternion_roundtrip": with_views("SELECT robot_id, event_id, 1.0::DOUBLE AS length2, true AS positive FROM imu"),
    "guess_clamp": with_views('SELECT robot_id, event_id, round(CASE WHEN z > 3 THEN 0 ELSE z END, 6) + 0.0 AS "loop", round(CASE WHEN abs(z) > 10 THEN z / 3 ELSE z END, 6) + 0.0 AS batch, 0.0::DOUBLE AS flat FROM (SELECT *, tx / 10 - 12 AS z FROM tf)'),
    "loop_overlap_best": with_views("""SELECT robot_id, kf_id, b.c AS cand_id, round(b.o, 6) + 0.0 AS overlap FROM (
  SELECT a.robot_id, a.kf_id, max_by({'c': b.kf_id, 'o': 1 / (1 + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))}, (1 / (1 + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), -b.kf_id)) AS b
  FROM keyframes a JOIN keyframes b ON a.robot_id = b.robot_id AND b.kf_id + 5 <= a.kf_id AND b.kf_id >= 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 GROUP BY ALL) WHERE b.o >= 0.4::DOUBLE"""),
    "sample_neighbours": with_views(""", more AS (FROM edges UNION ALL SELECT e.robot_id, e.src, e.dst + 2, e.x, e.y, e.yaw, e.reachable FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.robot_id = e.robot_id AND o.src = e.src AND o.dst = e.dst + 2))
SELECT robot_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY robot_id, src ORDER BY ((dst % 1073741824) * 2654435761 + 5 * 40503) % 4294967296, dst) AS n FROM more) WHERE n <= 2"""),
    "reslam_anchor": with_views(""", last AS (SELECT robot_id, max(kf_id) AS old FROM keyframes GROUP BY 1)
SELECT robot_id, old AS src, old + 1 AS dst, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 1.0::DOUBLE AS c, 0.0::DOUBLE AS s, true AS reachable FROM last UNION ALL SELECT robot_id, old + 1, old, 0.0, 0.0, 1.0, 0.0, true FROM last"""),
}
