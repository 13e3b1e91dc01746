"""Queries on ordered folds and keyframes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.operators import motion as M
from cairn.operators.alignment import align_windows
from cairn.operators.inertial import propagate
from cairn.operators.neighbours import loop_candidates as candidates
from cairn.operators.temporal import micros

from .views import PLANAR_SQL, imu, keyframes, odom, planar, planar_product, planar_relative, r6, scan_frames, with_views

CUTS = M.CutParams(min_gap=3, min_overlap=0.6, min_map_points=2000, max_map_points=9000, half_road_width=8.0, max_length=22.0, max_angle=2.0)


def _frames(spark, d):
    """Scan frames with an overlap, a heading and a size of the local map that follow from their place."""
    return scan_frames(spark, d).withColumns({"overlap": F.col("y") / 10, "yaw": (F.col("y") - 5) * 0.6, "map_points": F.col("x") * 200})


def gyro_bias_mean(spark, d):
    rows = imu(spark, d).withColumn("gz", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("gz")))
    return M.gyro_bias(rows).select("robot_id", r6("bias").alias("bias"), r6("bias_all").alias("bias_all"))


def static_start(spark, d):
    return M.static_start(imu(spark, d), wait_s=3 * 86400).select("robot_id", "event_id", "stamp")


def odom_fold(spark, d):
    return M.odom_preintegrate(odom(spark, d)).select("robot_id", *[r6(c).alias(c) for c in ("dx", "dy", "turn", "dt")])


def odom_covariance(spark, d):
    return M.odom_covariance(odom(spark, d)).select("robot_id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("xx", "xy", "xt", "yy", "yt", "tt")])


def _intervals(spark, d):
    return M.imu_intervals(scan_frames(spark, d), imu(spark, d))


def imu_preint(spark, d):
    return M.imu_preintegrate(_intervals(spark, d)).select("robot_id", "frame_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("px", "py", "vx", "vy", "turn", "dt")])


def imu_preint_cov(spark, d):
    """The full fold: motion, and its derivatives by the biases."""
    out = M.imu_covariances(_intervals(spark, d))
    return out.select("robot_id", "frame_id", *[(F.round(c, 4) + 0.0).alias(c) for c in ("px", "py", "p_ba", "r_bg")])


def nav_propagate(spark, d):
    """States behind frame 2, from a state given there."""
    start = {"x": 1.0, "y": 2.0, "z": 0.0, "vx": 1.0, "vy": 0.0, "vz": 0.0, "heading": 0.3}
    anchors = scan_frames(spark, d).where("frame_id = 2").select("robot_id", F.col("frame_id").alias("anchor"), *[F.lit(v).alias(k) for k, v in start.items()])
    out = M.nav_propagate(M.imu_preintegrate(_intervals(spark, d)), anchors)
    return out.select("robot_id", "frame_id", *[(F.round(c, 2) + 0.0).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz", "heading")])


#: Microseconds of a day.
DAY = 8.64e10


def _turning_samples(spark, d):
    """Inertial samples whose axis of turning changes from one to the next."""
    sevenths = F.col("event_id") % 7 - 3
    return imu(spark, d).select("robot_id", "event_id", "stamp", (F.col("gz") * 10).alias("wx"), (sevenths * 0.1).alias("wy"), (F.col("ax") / 10).alias("wz"), "ax", (F.col("gz") * 10).alias("ay"), (9.81 + sevenths * 0.01).alias("az"))


def so3_jacobians(spark, d):
    """Right and inverse left Jacobians of the turns within an hour, and how far a right Jacobian times its inverse is from the identity."""
    v = [F.col(c) for c in ("wx", "wy", "wz")]
    rows = _turning_samples(spark, d).select("event_id", P.so3_jacobian(*v).alias("right"), P.so3_jacobian(*v, left=True, inverse=True).alias("left_back"), P.so3_jacobian(*v, inverse=True).alias("back"))
    product = [sum((F.col("right")[3 * r + i] * F.col("back")[3 * i + c] for i in range(3)), F.lit(0.0)) - (1.0 if r == c else 0.0) for r in range(3) for c in range(3)]
    cells = [(F.round(F.col(n)[i], 6) + 0.0).alias(f"{n}_{i}") for n in ("right", "left_back") for i in (0, 1, 5, 6)]
    return rows.select("event_id", *cells, (F.greatest(*[F.abs(c) for c in product]) < 1e-9).alias("inverse"))


def so3_quaternions(spark, d):
    """Quaternions of turns of up to two full turns, by way of their matrices."""
    v = [F.col(c) * 6 for c in ("wx", "wy", "wz")]
    q = P.to_quaternion(P.so3_exp(*v))
    return _turning_samples(spark, d).select("event_id", q.alias("q")).select("event_id", *[(F.round(F.col(f"q.{n}"), 5) + 0.0).alias(n) for n in "wxyz"])


def nav_propagate_turning(spark, d):
    """States with full rotations behind each robot's third sample, whose state is given; time in days, five days to a bucket."""
    by = Window.partitionBy("robot_id").orderBy("stamp", "event_id")
    third = imu(spark, d).withColumn("n", F.row_number().over(by)).where("n = 3")
    anchors = third.select("robot_id", "stamp", P.from_yaw(F.lit(0.3), F.lit(1.0), F.lit(2.0)).alias("pose"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5)).alias("v"))
    out = propagate(_turning_samples(spark, d), anchors, unit=DAY, bucket_s=5 * 86400)
    cells = {"x": 3, "y": 7, "z": 11, "r00": 0, "r10": 4, "r20": 8, "r21": 9}
    return out.select("robot_id", "event_id", *[(F.round(F.col("pose")[i], 3) + 0.0).alias(n) for n, i in cells.items()], *[(F.round(F.col("v")[i], 3) + 0.0).alias(n) for i, n in enumerate(("vx", "vy", "vz"))])


def alignment_windows(spark, d):
    """Gravity and scale that fit poses at half their size to the samples between them, in windows of eight samples; the poses are states propagated from each robot's first sample."""
    samples = _turning_samples(spark, d)
    by = Window.partitionBy("robot_id").orderBy("stamp", "event_id")
    first = samples.withColumn("n", F.row_number().over(by)).where("n = 1")
    anchors = first.select("robot_id", "stamp", P.from_yaw(F.lit(0.3), F.lit(1.0), F.lit(2.0)).alias("pose"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.5)).alias("v"))
    states = propagate(samples, anchors, unit=DAY, bucket_s=5 * 86400).select("robot_id", "event_id", F.transform("pose", lambda x, i: F.when(i.isin(3, 7, 11), x / 2).otherwise(x)).alias("pose"))
    dt = (micros("stamp") - F.lag(micros("stamp")).over(by)) / DAY
    before = F.lag(F.array("ax", "ay", "az")).over(by)
    folds = samples.select("robot_id", "event_id", F.row_number().over(by).cast("long").alias("frame_id"), dt.alias("dt"), before.alias("a"))
    folds = folds.withColumns({"dv": F.transform("a", lambda x: x * F.col("dt")), "dp": F.transform("a", lambda x: 0.5 * x * F.col("dt") * F.col("dt"))})
    out = align_windows(folds.join(states, ["robot_id", "event_id"]), 8, 4)
    return out.select("robot_id", "window", "n", "ok", *[(F.round(c, 2) + 0.0).alias(c) for c in ("gx", "gy", "gz", "scale")])


def _posed(spark, d):
    return _frames(spark, d).select("robot_id", "frame_id", P.from_yaw(F.col("yaw"), F.col("x"), F.col("y")).alias("pose"))


def const_velocity(spark, d):
    return M.constant_velocity(_posed(spark, d)).select("robot_id", "frame_id", *planar(F.col("predicted")))


def initial_guess(spark, d):
    """Guesses from inertial deltas, by way of the sensor's place on the robot."""
    moved = M.imu_preintegrate(_intervals(spark, d)).join(_posed(spark, d), ["robot_id", "frame_id"])
    guess = M.initial_guess(F.col("pose"), P.from_yaw(F.col("turn"), F.col("px"), F.col("py")), P.from_yaw(F.lit(0.2), F.lit(0.5), F.lit(0.1)))
    return moved.select("robot_id", "frame_id", guess.alias("g")).select("robot_id", "frame_id", *[(F.round(F.col("g")[i], 4) + 0.0).alias(n) for i, n in ((3, "x"), (7, "y"), (0, "c"), (4, "s"))])


def window_samples(spark, d):
    """Inertial samples of every third frame, those of the frames skipped before it included."""
    out = M.window_samples(scan_frames(spark, d), _intervals(spark, d), 3)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.dt)
    return out.select("robot_id", "frame_id", F.size("samples").cast("long").alias("n"), (F.round(total, 4) + 0.0).alias("dt"))


def kf_features(spark, d):
    return M.frame_features(scan_frames(spark, d)).where("dx is not null").select("robot_id", "frame_id", *[r6(c).alias(c) for c in ("dx", "dy", "step")])


def kf_cut(spark, d):
    return M.keyframe_cuts(_frames(spark, d), CUTS).select("robot_id", "frame_id")


def kf_cut_plain(spark, d):
    """Cuts by the rules of plain scans: a wide gap, no turning."""
    return M.keyframe_cuts(_frames(spark, d), replace(M.PLAIN, min_gap=4, min_overlap=0.6, min_map_points=2000, max_map_points=9000, half_road_width=8.0, max_length=22.0)).select("robot_id", "frame_id")


def kf_reason(spark, d):
    return M.keyframe_cuts(_frames(spark, d), CUTS).select("robot_id", F.concat_ws("  ", "frame_id", "reason").alias("line"))


def frames_by_keyframe(spark, d):
    return M.frames_by_keyframe(scan_frames(spark, d), M.keyframe_cuts(_frames(spark, d), CUTS))


def loop_cooldown(spark, d):
    loops = candidates(keyframes(spark, d), 3.0).select("robot_id", "kf_id").distinct().join(keyframes(spark, d), ["robot_id", "kf_id"])
    return M.loop_cooldown(loops, 2 * 86400, 2)


def window_stride(spark, d):
    return M.strided_windows(scan_frames(spark, d), 5, 2)


def realtime_ratio(spark, d):
    """Processing time (here `value` hundredths of a second) as a percentage of the time since the previous scan."""
    by = Window.partitionBy("robot_id").orderBy("stamp", "frame_id")
    gap = micros("stamp") - F.lag(micros("stamp")).over(by)
    return scan_frames(spark, d).withColumn("ratio", 100 * F.col("x") * 1e5 / gap).where("ratio is not null").groupBy("robot_id").agg(r6(F.max("ratio")).alias("worst"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (gyro_bias_mean, static_start, odom_fold, odom_covariance, imu_preint, imu_preint_cov, nav_propagate, so3_jacobians, so3_quaternions, nav_propagate_turning, alignment_windows, const_velocity, initial_guess, kf_features, kf_cut, kf_cut_plain, kf_reason, frames_by_keyframe, loop_cooldown, window_stride, window_samples, realtime_ratio)}

FOLD = """, tagged AS (
  SELECT s.*, f.frame_id, f.stamp AS fin FROM imu s ASOF JOIN scan_frames f ON s.robot_id = f.robot_id AND s.stamp < f.stamp
), timed AS (
  SELECT *, greatest(0, (epoch_us(coalesce(lead(stamp) OVER w, fin)) - epoch_us(stamp)) / 3.6e9::DOUBLE) AS dt FROM tagged WINDOW w AS (PARTITION BY robot_id, frame_id ORDER BY stamp, event_id)
), turned AS (
  SELECT *, coalesce(sum(gz * dt) OVER w, 0) AS turn FROM timed WINDOW w AS (PARTITION BY robot_id, frame_id ORDER BY stamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pushed AS (
  SELECT *, cos(turn) * ax AS px_a, sin(turn) * ax AS py_a, coalesce(sum(cos(turn) * ax * dt) OVER w, 0) AS v0x, coalesce(sum(sin(turn) * ax * dt) OVER w, 0) AS v0y
  FROM turned WINDOW w AS (PARTITION BY robot_id, frame_id ORDER BY stamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), folded AS (
  SELECT robot_id, frame_id, sum(v0x * dt + 0.5::DOUBLE * px_a * dt * dt) AS px, sum(v0y * dt + 0.5::DOUBLE * py_a * dt * dt) AS py, sum(px_a * dt) AS vx, sum(py_a * dt) AS vy, sum(gz * dt) AS turn, sum(dt) AS dt
  FROM pushed GROUP BY ALL
)
"""


def _cuts(gap: int, angle: bool) -> str:
    turned = "acos(cos(f.yaw - c.yaw)) > 2" if angle else "false"
    return f""", seen AS (
  SELECT *, y / 10 AS overlap, (y - 5) * 0.6::DOUBLE AS yaw, x * 200 AS size FROM scan_frames
), cuts AS (
  SELECT robot_id, frame_id, frame_id AS id, x, y, yaw, false AS cut, CAST('' AS VARCHAR) AS reason FROM seen WHERE frame_id = 1
  UNION ALL
  SELECT robot_id, frame_id, CASE WHEN hit THEN frame_id ELSE id END, CASE WHEN hit THEN x ELSE x0 END, CASE WHEN hit THEN y ELSE y0 END, CASE WHEN hit THEN yaw ELSE yaw0 END, hit,
    CASE WHEN low THEN 'Overlap' WHEN big THEN 'MaxLocalMappoints' WHEN wide THEN 'T y Over' WHEN long THEN 'Too Long' ELSE 'angle too large' END
  FROM (SELECT *, low AND gap > {gap} AND size > 2000 OR big OR wide OR long OR turned AS hit FROM (
    SELECT f.robot_id, f.frame_id, f.x, f.y, f.yaw, f.size, c.id, c.x AS x0, c.y AS y0, c.yaw AS yaw0, f.frame_id - c.id AS gap, f.overlap < 0.6::DOUBLE AS low, f.size > 9000 AS big,
      abs(cos(c.yaw) * (f.y - c.y) - sin(c.yaw) * (f.x - c.x)) > 8 AS wide, sqrt((f.x - c.x) * (f.x - c.x) + (f.y - c.y) * (f.y - c.y)) > 22 AS long, {turned} AS turned
    FROM cuts c JOIN seen f ON f.robot_id = c.robot_id AND f.frame_id = c.frame_id + 1))
)
"""


_CUTS = _cuts(3, True)
_PREVIOUS = "(PARTITION BY robot_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = "(PARTITION BY robot_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SQL = {
    "gyro_bias_mean": with_views("SELECT robot_id, round(avg(gz) FILTER (event_id % 10 <> 0), 6) + 0.0 AS bias, round(sum(CASE WHEN event_id % 10 <> 0 THEN gz ELSE 0 END) / count(*), 6) + 0.0 AS bias_all FROM imu GROUP BY 1"),
    "static_start": with_views("""SELECT robot_id, min_by(event_id, (stamp, event_id)) AS event_id, min(stamp) AS stamp FROM (
  SELECT *, row_number() OVER w AS n, lag(ax) OVER w AS was, first(stamp) OVER w AS t0 FROM imu WINDOW w AS (PARTITION BY robot_id ORDER BY stamp, event_id))
  WHERE n > 3 AND abs(ax - was) > 0.1::DOUBLE AND stamp - t0 > INTERVAL 3 DAY GROUP BY 1"""),
    "odom_fold": with_views(""", step AS (
  SELECT *, (epoch_us(stamp) - epoch_us(lag(stamp) OVER w)) / 3.6e9::DOUBLE AS dt, lag(vx) OVER w AS v, lag(wz) OVER w AS r FROM odom WINDOW w AS (PARTITION BY robot_id ORDER BY stamp, event_id)
), head AS (
  SELECT *, sum(r * dt) OVER (PARTITION BY robot_id ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING) - r * dt AS heading FROM step WHERE dt IS NOT NULL)
SELECT robot_id, round(sum(v * cos(heading) * dt), 6) + 0.0 AS dx, round(sum(v * sin(heading) * dt), 6) + 0.0 AS dy, round(sum(r * dt), 6) + 0.0 AS turn, round(sum(dt), 6) + 0.0 AS dt FROM head GROUP BY 1"""),
    "odom_covariance": with_views(""", steps AS (
  SELECT robot_id, row_number() OVER w - 1 AS i, (epoch_us(stamp) - epoch_us(lag(stamp) OVER w)) / 3.6e9::DOUBLE AS dt, lag(vx) OVER w AS v, lag(wz) OVER w AS r FROM odom WINDOW w AS (PARTITION BY robot_id ORDER BY stamp, event_id)
), folded AS (
  SELECT DISTINCT robot_id, 0::BIGINT AS i, 0::DOUBLE AS h, 0::DOUBLE AS xx, 0::DOUBLE AS xy, 0::DOUBLE AS xt, 0::DOUBLE AS yy, 0::DOUBLE AS yt, 0::DOUBLE AS tt FROM steps
  UNION ALL
  SELECT robot_id, i, h + r * dt, xx + 2 * a * xt + a * a * tt + q * cos(h) * cos(h), xy + b * xt + a * yt + a * b * tt + q * cos(h) * sin(h), xt + a * tt, yy + 2 * b * yt + b * b * tt + q * sin(h) * sin(h), yt + b * tt, tt + 1e-4::DOUBLE * dt * dt
  FROM (SELECT f.* EXCLUDE (i), s.i, s.dt, s.r, -sin(f.h) * s.v * s.dt AS a, cos(f.h) * s.v * s.dt AS b, 1e-2::DOUBLE * s.dt * s.dt AS q FROM folded f JOIN steps s ON s.robot_id = f.robot_id AND s.i = f.i + 1))
SELECT robot_id, """ + ", ".join(f"round({c}, 3) + 0.0 AS {c}" for c in ("xx", "xy", "xt", "yy", "yt", "tt")) + " FROM (SELECT *, max(i) OVER (PARTITION BY robot_id) AS last FROM folded) WHERE i = last AND i > 0", recursive=True),
    "imu_preint": with_views(FOLD + "SELECT robot_id, frame_id, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("px", "py", "vx", "vy", "turn", "dt")) + " FROM folded"),
    "imu_preint_cov": with_views(FOLD + """, reach AS (
  SELECT *, coalesce(sum(cos(turn) * dt) OVER w, 0) AS upto FROM turned WINDOW w AS (PARTITION BY robot_id, frame_id ORDER BY stamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), by_bias AS (
  SELECT robot_id, frame_id, -sum(upto * dt + 0.5::DOUBLE * cos(turn) * dt * dt) AS p_ba, -sum(dt) AS r_bg FROM reach GROUP BY ALL)
SELECT robot_id, frame_id, round(px, 4) + 0.0 AS px, round(py, 4) + 0.0 AS py, round(p_ba, 4) + 0.0 AS p_ba, round(r_bg, 4) + 0.0 AS r_bg FROM folded JOIN by_bias USING (robot_id, frame_id)"""),
    "nav_propagate": with_views(FOLD + f""", turning AS (SELECT *, 0.3::DOUBLE + coalesce(sum(turn) OVER {_PREVIOUS}, 0) AS h FROM folded WHERE frame_id > 2
), pushes AS (SELECT *, cos(h) * vx - sin(h) * vy AS gx, sin(h) * vx + cos(h) * vy AS gy, -9.81::DOUBLE * dt AS gz FROM turning
), speeds AS (SELECT *, 1 + coalesce(sum(gx) OVER {_PREVIOUS}, 0) AS v0, coalesce(sum(gy) OVER {_PREVIOUS}, 0) AS v1, coalesce(sum(gz) OVER {_PREVIOUS}, 0) AS v2 FROM pushes
), moves AS (SELECT *, v0 * dt + cos(h) * px - sin(h) * py AS mx, v1 * dt + sin(h) * px + cos(h) * py AS my, v2 * dt - 0.5::DOUBLE * 9.81::DOUBLE * dt * dt AS mz FROM speeds)
SELECT robot_id, frame_id, round(1 + sum(mx) OVER {_UPTO}, 2) + 0.0 AS x, round(2 + sum(my) OVER {_UPTO}, 2) + 0.0 AS y, round(sum(mz) OVER {_UPTO}, 2) + 0.0 AS z,
  round(v0 + gx, 2) + 0.0 AS vx, round(v1 + gy, 2) + 0.0 AS vy, round(v2 + gz, 2) + 0.0 AS vz, round(h + turn, 2) + 0.0 AS heading FROM moves"""),
    "so3_quaternions": with_views(""", turns AS (SELECT event_id, gz * 60 AS x, (event_id % 7 - 3) * 0.6::DOUBLE AS y, ax * 6 / 10 AS z FROM imu), sized AS (SELECT *, sqrt(x * x + y * y + z * z) AS a FROM turns
), halves AS (SELECT *, cos(a / 2) AS c, CASE WHEN a < 1e-5::DOUBLE THEN 0.5 ELSE sin(a / 2) / a END * CASE WHEN cos(a / 2) < 0 THEN -1 ELSE 1 END AS s FROM sized)
SELECT event_id, round(abs(c), 5) + 0.0 AS w, round(s * x, 5) + 0.0 AS x, round(s * y, 5) + 0.0 AS y, round(s * z, 5) + 0.0 AS z FROM halves"""),
    "so3_jacobians": with_views(""", turns AS (SELECT event_id, gz * 10 AS x, (event_id % 7 - 3) * 0.1::DOUBLE AS y, ax / 10 AS z FROM imu), sized AS (SELECT *, sqrt(x * x + y * y + z * z) AS a FROM turns
), parts AS (SELECT *, CASE WHEN a < 1e-5::DOUBLE THEN 0 ELSE (1 - cos(a)) / (a * a) END AS c, CASE WHEN a < 1e-5::DOUBLE THEN 0 ELSE (a - sin(a)) / (a * a * a) END AS s,
  CASE WHEN a < 1e-5::DOUBLE THEN 0 ELSE 0.5::DOUBLE END AS h, CASE WHEN a < 1e-5::DOUBLE THEN 0 ELSE 1 / (a * a) - (1 + cos(a)) / (2 * a * sin(a)) END AS q FROM sized)
SELECT event_id, round(1 - s * (y * y + z * z), 6) + 0.0 AS right_0, round(c * z + s * x * y, 6) + 0.0 AS right_1, round(c * x + s * y * z, 6) + 0.0 AS right_5, round(c * y + s * x * z, 6) + 0.0 AS right_6,
  round(1 - q * (y * y + z * z), 6) + 0.0 AS left_back_0, round(h * z + q * x * y, 6) + 0.0 AS left_back_1, round(h * x + q * y * z, 6) + 0.0 AS left_back_5, round(h * y + q * x * z, 6) + 0.0 AS left_back_6, true AS inverse FROM parts"""),
    "nav_propagate_turning": with_views(""", numbered AS (
  SELECT *, row_number() OVER w AS n, coalesce((epoch_us(lead(stamp) OVER w) - epoch_us(stamp)) / 8.64e10::DOUBLE, 0) AS dt, gz * 10 AS wx, (event_id % 7 - 3) * 0.1::DOUBLE AS wy, ax / 10 AS wz, [ax, gz * 10, 9.81::DOUBLE + (event_id % 7 - 3) * 0.01::DOUBLE] AS a
  FROM imu WINDOW w AS (PARTITION BY robot_id ORDER BY stamp, event_id)
), angled AS (SELECT *, sqrt(wx * wx + wy * wy + wz * wz) * dt AS q FROM numbered
), axes AS (SELECT *, CASE WHEN q < 1e-5::DOUBLE THEN 1 ELSE sin(q) / q END * dt AS s, CASE WHEN q < 1e-5::DOUBLE THEN 0 ELSE (1 - cos(q)) / (q * q) END * dt * dt AS c FROM angled
), turns AS (
  SELECT robot_id, event_id, n, dt, a, [1 - c * (wy * wy + wz * wz), c * wx * wy - s * wz, c * wx * wz + s * wy, c * wx * wy + s * wz, 1 - c * (wx * wx + wz * wz), c * wy * wz - s * wx, c * wx * wz - s * wy, c * wy * wz + s * wx, 1 - c * (wx * wx + wy * wy)] AS e FROM axes
), states AS (
  SELECT robot_id, n, event_id, [cos(0.3::DOUBLE), -sin(0.3::DOUBLE), 0, sin(0.3::DOUBLE), cos(0.3::DOUBLE), 0, 0, 0, 1] AS r, [1, 0, 0.5::DOUBLE] AS v, [1, 2, 0::DOUBLE] AS p FROM turns WHERE n = 3
  UNION ALL
  SELECT robot_id, n + 1, after, list_transform(range(9), lambda i: r[i // 3 * 3 + 1] * e[i % 3 + 1] + r[i // 3 * 3 + 2] * e[i % 3 + 4] + r[i // 3 * 3 + 3] * e[i % 3 + 7]),
    list_transform(range(1, 4), lambda i: v[i] + f[i] * dt), list_transform(range(1, 4), lambda i: p[i] + v[i] * dt + 0.5::DOUBLE * f[i] * dt * dt)
  FROM (SELECT s.*, t.e, t.dt, u.event_id AS after, list_transform(range(3), lambda i: s.r[i * 3 + 1] * t.a[1] + s.r[i * 3 + 2] * t.a[2] + s.r[i * 3 + 3] * t.a[3] - CASE WHEN i = 2 THEN 9.81::DOUBLE ELSE 0 END) AS f
        FROM states s JOIN turns t ON t.robot_id = s.robot_id AND t.n = s.n JOIN turns u ON u.robot_id = s.robot_id AND u.n = s.n + 1))
SELECT robot_id, event_id, round(p[1], 3) + 0.0 AS x, round(p[2], 3) + 0.0 AS y, round(p[3], 3) + 0.0 AS z, round(r[1], 3) + 0.0 AS r00, round(r[4], 3) + 0.0 AS r10, round(r[7], 3) + 0.0 AS r20, round(r[8], 3) + 0.0 AS r21,
  round(v[1], 3) + 0.0 AS vx, round(v[2], 3) + 0.0 AS vy, round(v[3], 3) + 0.0 AS vz FROM states""", recursive=True),
    "alignment_windows": with_views(""", counted AS (SELECT robot_id, count(*) AS total FROM imu GROUP BY 1), windows AS (SELECT robot_id, total, unnest(range((total - 1) // 4 + 1)) AS w FROM counted)
SELECT robot_id, w AS "window", least(8, total - 4 * w) AS n, n >= 4 AS ok, CASE WHEN n >= 4 THEN 0.0::DOUBLE END AS gx, CASE WHEN n >= 4 THEN 0.0::DOUBLE END AS gy, CASE WHEN n >= 4 THEN -9.81::DOUBLE END AS gz, CASE WHEN n >= 4 THEN 2.0::DOUBLE END AS scale FROM windows"""),
    "const_velocity": with_views(f""", posed AS (SELECT robot_id, frame_id, x, y, (y - 5) * 0.6::DOUBLE AS yaw FROM scan_frames), steps AS (
  SELECT f.robot_id, f.frame_id, {planar_relative("b", "a")} FROM posed f JOIN posed a ON a.robot_id = f.robot_id AND a.frame_id = f.frame_id - 1 JOIN posed b ON b.robot_id = f.robot_id AND b.frame_id = f.frame_id - 2
), ahead AS (
  SELECT t.robot_id, t.frame_id, {planar_product("a", "t")} FROM steps t JOIN posed a ON a.robot_id = t.robot_id AND a.frame_id = t.frame_id - 1)
SELECT robot_id, frame_id, {PLANAR_SQL} FROM ahead"""),
    "initial_guess": with_views(FOLD + f""", posed AS (SELECT robot_id, frame_id, x, y, (y - 5) * 0.6::DOUBLE AS yaw FROM scan_frames), e AS (SELECT 0.5::DOUBLE AS x, 0.1::DOUBLE AS y, 0.2::DOUBLE AS yaw
), o AS (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS yaw), back AS (SELECT {planar_relative("e", "o")} FROM e, o
), moved AS (SELECT robot_id, frame_id, px AS x, py AS y, turn AS yaw FROM folded), one AS (SELECT m.robot_id, m.frame_id, {planar_product("e", "m")} FROM moved m, e
), two AS (SELECT m.robot_id, m.frame_id, {planar_product("m", "b")} FROM one m, back b
), ahead AS (SELECT m.robot_id, m.frame_id, {planar_product("k", "m")} FROM two m JOIN posed k USING (robot_id, frame_id))
SELECT robot_id, frame_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(cos(yaw), 4) + 0.0 AS c, round(sin(yaw), 4) + 0.0 AS s FROM ahead"""),
    "window_samples": with_views(FOLD + """, numbered AS (SELECT robot_id, frame_id, row_number() OVER (PARTITION BY robot_id ORDER BY frame_id) AS n FROM scan_frames)
SELECT robot_id, max(frame_id) AS frame_id, CAST(coalesce(sum(m), 0) AS BIGINT) AS n, round(coalesce(sum(t), 0), 4) + 0.0 AS dt
FROM numbered LEFT JOIN (SELECT robot_id, frame_id, count(*) AS m, sum(dt) AS t FROM timed GROUP BY ALL) USING (robot_id, frame_id) GROUP BY robot_id, (n + 2) // 3 HAVING count(*) = 3"""),
    "kf_cut_plain": with_views(_cuts(4, False) + "SELECT robot_id, frame_id FROM cuts WHERE cut", recursive=True),
    "kf_features": with_views("SELECT robot_id, frame_id, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(sqrt(dx * dx + dy * dy), 6) + 0.0 AS step FROM (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM scan_frames WINDOW w AS (PARTITION BY robot_id ORDER BY frame_id)) WHERE dx IS NOT NULL"),
    "kf_cut": with_views(_CUTS + "SELECT robot_id, frame_id FROM cuts WHERE cut", recursive=True),
    "kf_reason": with_views(_CUTS + "SELECT robot_id, frame_id || '  ' || reason AS line FROM cuts WHERE cut", recursive=True),
    "frames_by_keyframe": with_views(_CUTS + """SELECT robot_id, kf_id, count(*) AS n_frames, min(frame_id) AS first_frame FROM (
  SELECT robot_id, frame_id, cut, CAST(sum(CAST(cut AS INTEGER)) OVER (PARTITION BY robot_id ORDER BY frame_id) AS BIGINT) AS kf_id FROM cuts) WHERE NOT cut GROUP BY ALL""", recursive=True),
    "loop_cooldown": with_views(""", found AS (
  SELECT DISTINCT a.robot_id, a.kf_id, a.stamp FROM keyframes a JOIN keyframes b ON a.robot_id = b.robot_id AND b.kf_id + 5 <= a.kf_id AND b.kf_id >= 1 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9
), numbered AS (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY kf_id) AS n FROM found), taken AS (
  SELECT robot_id, n, kf_id AS id, stamp AS t, true AS ok FROM numbered WHERE n = 1
  UNION ALL
  SELECT l.robot_id, l.n, CASE WHEN hit THEN l.kf_id ELSE l.id END, CASE WHEN hit THEN l.stamp ELSE l.t END, hit
  FROM (SELECT l.*, s.id, s.t, l.stamp - s.t >= INTERVAL 2 DAY AND l.kf_id - s.id >= 2 AS hit FROM taken s JOIN numbered l ON l.robot_id = s.robot_id AND l.n = s.n + 1) l)
SELECT robot_id, id AS kf_id FROM taken WHERE ok""", recursive=True),
    "window_stride": with_views("SELECT robot_id, frame_id, least(n, 5) AS n, greatest(1, frame_id - 4) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY frame_id) AS n FROM scan_frames) WHERE n % 2 = 0"),
    "realtime_ratio": with_views("""SELECT robot_id, round(max(ratio), 6) + 0.0 AS worst, count(*) AS n FROM (
  SELECT robot_id, 100 * x * 1e5::DOUBLE / (epoch_us(stamp) - epoch_us(lag(stamp) OVER (PARTITION BY robot_id ORDER BY stamp, frame_id))) AS ratio FROM scan_frames) WHERE ratio IS NOT NULL GROUP BY 1"""),
}
