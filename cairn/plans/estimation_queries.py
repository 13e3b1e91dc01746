"""Queries on registration and least squares."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.operators import clouds, graph, gravity, large_graphs, loop_closing, motion, neighbours, registration, scans, smoothing, solve
from cairn.operators.temporal import micros
from cairn.sources import formats
from cairn.sources.shared import materialize

from .motion_queries import FOLD as _FOLD
from .views import edges, imu, keyframes, nodes, points, poses, r6, scan_frames, with_views

ICP = registration.IcpParams(max_dist=2.0)


def _sides(spark, d):
    p = points(spark, d)
    return p.where("cloud_id % 2 = 1"), p.where("cloud_id % 2 = 0")


def _matched(spark, d):
    reading, reference = _sides(spark, d)
    return registration.matches(reading, reference, ICP)


def icp_normal_eq(spark, d):
    out = registration.normal_equations(_matched(spark, d))
    return out.select(*[(F.round(c, 3) + 0.0).alias(c) for c in out.columns if c != "n"], "n")


def trimmed_quantile(spark, d):
    return _matched(spark, d).where("d2 is not null").groupBy("cloud_id").agg(r6(F.percentile_approx("d2", 0.75, 100_000)).alias("q75"), F.count("*").alias("n"))


def overlap_ratio(spark, d):
    return _matched(spark, d).groupBy("cloud_id").agg(r6(F.count_if("keep") / F.count("*")).alias("overlap"))


def overlap_gate(spark, d):
    """Submaps whose matches overlap enough to be taken as scans."""
    found = _matched(spark, d).groupBy("cloud_id").agg((F.count_if("keep") / F.count("*")).alias("overlap"), F.lit(True).alias("ok"))
    return registration.overlap_gate(found, 0.3).select("cloud_id", r6("overlap").alias("overlap"))


def _registered(out):
    return out.select("pair", "ok", *[(F.round(F.col("t")[i], 4) + 0.0).alias(n) for i, n in ((3, "tx"), (7, "ty"), (11, "tz"), (0, "r00"), (4, "r10"))])


def icp_pair(spark, d):
    """Each submap, turned by 0.02 rad and shifted, registered back to itself."""
    p = points(spark, d).withColumn("pair", F.col("cloud_id"))
    moved = clouds.move(p, P.from_yaw(F.lit(0.02), F.lit(0.05), F.lit(-0.03), F.lit(0.02)), normals=True)
    return _registered(registration.register_pairs(moved, p, ICP))


CHAIN = """
readingDataPointsFilters:
  - MaxDistDataPointsFilter:
      maxDist: 1000
referenceDataPointsFilters:
#  - RandomSamplingDataPointsFilter:
#      prob: 0.2
matcher:
  KDTreeMatcher:
    knn: 1
    maxDist: 2
outlierFilters:
  - TrimmedDistOutlierFilter:
     ratio: 0.75
  - SurfaceNormalOutlierFilter:
     maxAngle: 1.57
errorMinimizer:
  PointToPlaneErrorMinimizer
transformationCheckers:
  - DifferentialTransformationChecker:
      minDiffRotErr: 0.0001
      minDiffTransErr: 0.0001
      smoothLength: 2
  - CounterTransformationChecker:
      maxIterationCount: 40
  - BoundTransformationChecker:
      maxRotationNorm: 0.80
      maxTranslationNorm: 30.00
logger:
  NullLogger
"""


def icp_configured(spark, d):
    """Submaps far off their places, registered from guesses of their own by a configured chain."""
    p = registration.configured(formats.parse_sections(CHAIN))
    own = points(spark, d).withColumn("pair", F.col("cloud_id"))
    moved = clouds.move(own, P.from_yaw(F.lit(0.3), F.lit(4.0), F.lit(-2.0), F.lit(0.5)), normals=True)
    guess = own.select("pair").distinct().select("pair", P.inverse(P.from_yaw(F.lit(0.29), F.lit(3.97), F.lit(-2.02), F.lit(0.5))).alias("start"))
    reading, reference = clouds.apply_chain(moved, list(p.reading_filters)), clouds.apply_chain(own, list(p.reference_filters))
    return _registered(registration.register_pairs(reading, reference, p, guess))


def merge_clouds(spark, d):
    """A submap and a moved copy of it, registered and merged."""
    one = points(spark, d).where("cloud_id = 2")
    other = clouds.move(one.withColumn("point_id", F.col("point_id") + 1_000_000), P.from_yaw(F.lit(0.01), F.lit(0.05), F.lit(-0.03)), normals=True)
    return registration.merge_clouds(one, other, ICP).select("point_id", *[(F.round(c, 3) + 0.0).alias(c) for c in "xyz"])


def surface_density(spark, d):
    p = points(spark, d)
    return registration.surface_normals(neighbours.knn(p, p, 5, 4.0)).select("point_id", r6("density").alias("density"))


def surface_normals(spark, d):
    """Lengths of fitted normals, and how far neighbours spread along them: the least variance in any direction."""
    p = points(spark, d)
    n = registration.surface_normals(neighbours.knn(p, p, 5, 4.0))
    return n.select("point_id", r6(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2).alias("length2"), (F.round("spread", 4) + 0.0).alias("spread"))


INPUT_CHAIN = """
- FixStepSamplingDataPointsFilter:
    startStep: 2
- RandomSamplingDataPointsFilter:
    prob: 0.8
- SurfaceNormalDataPointsFilter:
    knn: 4
    keepNormals: 1
    keepDensities: 1
- MaxDensityDataPointsFilter:
    maxDensity: 200.0
- SimpleSensorNoiseDataPointsFilter:
    sensorType: 0
- ObservationDirectionDataPointsFilter
- OrientNormalsDataPointsFilter
"""


def chain_input(spark, d):
    """The chain for scans: thinned, with normals that face the sensor, densities and noise."""
    out = clouds.apply_chain(points(spark, d), formats.parse_chain(INPUT_CHAIN))
    facing = F.col("nx") * F.col("ox") + F.col("ny") * F.col("oy") + F.col("nz") * F.col("oz") >= 0
    return out.select("cloud_id", "point_id", (F.round("density", 6) + 0.0).alias("density"), r6("noise").alias("noise"), facing.alias("facing"))


def chain_voxels(spark, d):
    """A voxel grid within a chain keeps clouds apart, and ids and descriptors for the filters behind it."""
    out = clouds.apply_chain(points(spark, d), formats.parse_chain("- VoxelGridDataPointsFilter:\n    vSizeX: 2\n    vSizeY: 3\n    vSizeZ: 4\n- MaxDistDataPointsFilter:\n    maxDist: 3\n    dim: -1\n"))
    return out.select("cloud_id", "point_id", *[r6(c).alias(c) for c in ("x", "y", "z", "nx", "p_static")])


def pose_graph(spark, d):
    """Graphs with exact edges from disturbed poses: optimization restores the poses relative to node 0."""
    at = nodes(spark, d)
    off = lambda k, step: F.when(F.col("node") > 0, step * (F.col("node") % k)).otherwise(0.0)
    shaken = at.withColumn("pose", P.product(F.col("pose"), P.from_yaw(off(4, 0.05), off(3, 0.1), off(2, -0.1))))
    out = solve.optimize_graphs(shaken, graph.optimizable(edges(spark, d), at).select("robot_id", "src", "dst", "pose"))
    return out.select("robot_id", "node", *[(F.round(F.col("pose")[i], 3) + 0.0).alias(n) for i, n in ((3, "x"), (7, "y"), (0, "c"), (4, "s"))])


def pose_graph_parts(spark, d):
    """The same through parts of eight nodes: no graph of more is in one task."""
    at = nodes(spark, d)
    off = lambda k, step: F.when(F.col("node") > 0, step * (F.col("node") % k)).otherwise(0.0)
    shaken = at.withColumn("pose", P.product(F.col("pose"), P.from_yaw(off(4, 0.05), off(3, 0.1), off(2, -0.1))))
    out = large_graphs.optimize_large_graphs(shaken, graph.optimizable(edges(spark, d), at).select("robot_id", "src", "dst", "pose"), iterations=6, part_nodes=8)
    return out.select("robot_id", "node", *[(F.round(F.col("pose")[i], 3) + 0.0).alias(n) for i, n in ((3, "x"), (7, "y"), (0, "c"), (4, "s"))])


def world(spark, d):
    """All submaps' points in one world."""
    return clouds.move(points(spark, d).join(poses(spark), "cloud_id"), F.col("pose"), normals=True).drop("pose")


def drifted(spark, d):
    """(nodes, edges): keyframes by drifting odometry. Each step has its own small error, so the path bends away from the true one."""
    wrong = P.from_yaw(((F.col("src") * 37 + F.col("robot_id")) % 7 - 3) * 0.004, ((F.col("src") * 53 + F.col("robot_id")) % 5 - 2) * 0.04, ((F.col("src") * 29 + F.col("robot_id")) % 5 - 2) * 0.04)
    e = edges(spark, d).where("reachable").withColumn("pose", P.product(F.col("pose"), wrong))
    start = nodes(spark, d).where("node = 0")
    at = materialize(graph.traverse(e, start).select("robot_id", "node", "pose"))
    return at, e


def seen_points(spark, d, reach=5.0):
    """What each keyframe sees from its true place: the world's points within reach, in its own frame."""
    seen = neighbours.within(keyframes(spark, d).withColumn("z", F.lit(0.0)), world(spark, d), reach)
    rows = seen.select(F.col("l.robot_id").alias("robot_id"), F.col("l.kf_id").alias("node"), *[F.col(f"r.{c}").alias(c) for c in ("point_id", "x", "y", "z", "nx", "ny", "nz", "p_static")])
    back = nodes(spark, d).select("robot_id", "node", P.inverse(F.col("pose")).alias("pose"))
    return clouds.move(rows.join(back, ["robot_id", "node"]), F.col("pose"), normals=True).drop("pose")


def _closed(spark, d):
    """Scans of less than twenty points are no scans; matches have to overlap by six tenths, as the world's points are sparse."""
    at, e = drifted(spark, d)
    sane = scans.scans(nodes(spark, d), world(spark, d), 5.0).where("n >= 20")
    return at, loop_closing.close_loops(at, e, sane, radius=4.0, min_overlap=0.6, most_shift=3.0, p=replace(ICP, min_translation=0.001, min_rotation=0.0001))


def loop_closure_pairs(spark, d):
    """All near pairs of drifted keyframes with what their registration came to."""
    return _closed(spark, d)[1].pairs.select("robot_id", "src", "dst", "ok", (F.round("overlap", 6) + 0.0).alias("overlap"), "passed")


def loop_closure(spark, d):
    """Robots whose loops were closed: mean distance of their keyframes from the true places by odometry and after optimization."""
    at, closed = _closed(spark, d)
    true = nodes(spark, d).select("robot_id", "node", F.col("pose").alias("true"))
    off = lambda c: F.sqrt((F.col(c)[3] - F.col("true")[3]) ** 2 + (F.col(c)[7] - F.col("true")[7]) ** 2)
    gained = closed.pairs.where("passed").groupBy("robot_id").agg(F.count("*").alias("loops"))
    rows = true.join(at.withColumnRenamed("pose", "was"), ["robot_id", "node"]).join(closed.nodes.select("robot_id", "node", F.col("pose").alias("now")), ["robot_id", "node"])
    return rows.groupBy("robot_id").agg((F.round(F.avg(off("was")), 4) + 0.0).alias("before"), (F.round(F.avg(off("now")), 4) + 0.0).alias("after")).join(gained, "robot_id")


def gyro_bias_gn(spark, d):
    """Bias of the turn rates against the headings between scans."""
    by = Window.partitionBy("robot_id").orderBy("frame_id")
    f = scan_frames(spark, d).withColumns({"hx": F.col("x") - F.lag("x").over(by), "hy": F.col("y") - F.lag("y").over(by)})
    f = f.withColumn("heading", F.atan2("hy", "hx")).withColumn("seen", P.wrap_angle(F.col("heading") - F.lag("heading").over(by), math.pi)).where("seen is not null")
    turns = motion.imu_preintegrate(motion.imu_intervals(scan_frames(spark, d), imu(spark, d))).join(f.select("robot_id", "frame_id", "seen"), ["robot_id", "frame_id"])
    return solve.gyro_bias(turns).select("robot_id", r6("bias").alias("bias"), "n")


def _smooth_path(spark, d):
    """Frames of each robot with their true places and speeds, and the two samples of half a second between each two that fit them."""
    by = Window.partitionBy("robot_id").orderBy("frame_id")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    f = scan_frames(spark, d).select("robot_id", "frame_id", (F.col("x") / 100).alias("x"), (F.col("y") / 100).alias("y"))
    # a constant pull between two frames takes the speed to twice the mean one less the speed before
    sign = F.when(F.col("frame_id") % 2 == 0, 1.0).otherwise(-1.0)
    for a in "xy":
        step = F.coalesce(F.col(a) - F.lag(a).over(by), F.lit(0.0))
        f = f.withColumn(f"d{a}", step).withColumn(f"v{a}", sign * F.sum(sign * 2 * F.col(f"d{a}")).over(upto))
    f = f.withColumns({f"a{a}": F.col(f"v{a}") - F.coalesce(F.lag(f"v{a}").over(by), F.lit(0.0)) for a in "xy"})
    zero = F.lit(0.0)
    sample = F.struct(F.lit(0.5).alias("dt"), zero.alias("wx"), zero.alias("wy"), zero.alias("wz"), "ax", "ay", zero.alias("az"))
    return f, f.select("robot_id", "frame_id", F.array(sample, sample).alias("samples"))


def smoother(spark, d):
    """Windows of the stated size over each robot's whole path, from places 0.05 off, with samples that fit it: speeds go on from frame to frame, a second each."""
    f, steps = _smooth_path(spark, d)
    zero = F.lit(0.0)
    states = f.select("robot_id", "frame_id", P.from_yaw(zero, F.col("x"), F.col("y")).alias("pose"), F.array("vx", "vy", zero).alias("v"))
    off = states.withColumn("start", P.product(F.col("pose"), P.from_yaw(zero, F.when((F.col("frame_id") - 1) % 3 > 0, 0.05).otherwise(0.0), zero)))
    out = smoothing.smooth_windows(off, steps).join(f.select("robot_id", "frame_id", "x", "y"), ["robot_id", "frame_id"])
    near = (F.abs(F.col("pose")[3] - F.col("x")) < 0.01) & (F.abs(F.col("pose")[7] - F.col("y")) < 0.01)
    return out.select("robot_id", "frame_id", near.alias("near"), "ok")


def smoother_noise(spark, d):
    """Mean distance from the true places of noisy poses, and of the same after smoothing with samples that fit the true path."""
    f, steps = _smooth_path(spark, d)
    noise = lambda k: F.when(F.col("frame_id") > 1, ((F.col("frame_id") * k + F.col("robot_id")) % 11 - 5) * 0.02).otherwise(0.0)
    zero = F.lit(0.0)
    seen = P.from_yaw(noise(23) * 0.1, F.col("x") + noise(37), F.col("y") + noise(53))
    states = f.select("robot_id", "frame_id", seen.alias("pose"), seen.alias("start"), F.array("vx", "vy", zero).alias("v"))
    out = smoothing.smooth_windows(states, steps).select("robot_id", "frame_id", F.col("pose").alias("now"), "ok")
    rows = out.join(states, ["robot_id", "frame_id"]).join(f.select("robot_id", "frame_id", "x", "y"), ["robot_id", "frame_id"])
    gap = lambda c: F.sqrt((F.col(c)[3] - F.col("x")) ** 2 + (F.col(c)[7] - F.col("y")) ** 2)
    return rows.groupBy("robot_id").agg((F.round(F.avg(gap("pose")), 3) + 0.0).alias("before"), (F.round(F.avg(gap("now")), 3) + 0.0).alias("after"), F.every("ok").alias("ok"))


def gravity_ba(spark, d):
    """Gravity and accelerometer bias per robot from still samples at known tilts, planted with a bias of (0.05, -0.02, 0.03)."""
    rows = imu(spark, d).select("robot_id", "event_id", (F.col("gz") * 10).alias("roll"), (F.col("ax") / 10).alias("pitch"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        r = [motion.exp_so3(np.array([a, 0, 0])) @ motion.exp_so3(np.array([0, b, 0])) for a, b in zip(pdf["roll"], pdf["pitch"], strict=True)]
        acc = [m.T @ np.array([0, 0, 9.81]) + np.array([0.05, -0.02, 0.03]) for m in r]
        g, bias = solve.gravity_and_bias(np.array(acc), r, prior=1e-3)
        return pd.DataFrame({"robot_id": [pdf["robot_id"].iloc[0]], "n": [len(pdf)], "gz": [g[2]], "length": [float(np.linalg.norm(g))], "bias_x": [bias[0]]})

    return rows.groupBy("robot_id").applyInPandas(run, "robot_id long, n long, gz double, length double, bias_x double").select("robot_id", "n", F.round("gz", 2).alias("gz"), F.round("length", 4).alias("length"), F.round("bias_x", 2).alias("bias_x"))


def gravity_by_sums(spark, d):
    """Gravity and bias per robot from its samples as they are, at rotations by its turn rates, with the prior of 300."""
    rows = imu(spark, d).select("robot_id", P.from_roll_pitch_yaw(F.col("gz") * 4, F.col("ax") / 20, F.col("gz")).alias("pose"), (F.col("ax") / 10).alias("ax"), (F.col("gz") * 5).alias("ay"), (9.6 + F.col("event_id") % 7 * 0.1).alias("az"))
    out = gravity.gravity_by_sums(rows)
    return out.select("robot_id", "n", *[(F.round(c, 3) + 0.0).alias(c) for c in ("gx", "gy", "gz", "bias_x", "bias_y", "bias_z")])


def realtime_gaps(spark, d):
    """Longest time between scans of each robot, in hours."""
    by = Window.partitionBy("robot_id").orderBy("frame_id")
    return scan_frames(spark, d).withColumn("gap", (micros("stamp") - F.lag(micros("stamp")).over(by)) / 3.6e9).groupBy("robot_id").agg(r6(F.max("gap")).alias("gap"))


QUERIES = {f.__name__: f for f in (icp_normal_eq, trimmed_quantile, overlap_ratio, overlap_gate, icp_pair, icp_configured, merge_clouds, surface_density, surface_normals, chain_input, chain_voxels, pose_graph, pose_graph_parts, loop_closure_pairs, loop_closure, gyro_bias_gn, gravity_ba, gravity_by_sums, smoother, smoother_noise, realtime_gaps)}

_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_MATCH = f""", near AS (
  SELECT a.point_id, min(({_D2}, b.point_id)) AS m FROM points a JOIN points b ON a.cloud_id % 2 = 1 AND b.cloud_id % 2 = 0 WHERE {_D2} <= 4 GROUP BY 1
), lim AS (SELECT quantile_disc(m[1], 0.75) AS q FROM near), matched AS (
  SELECT a.*, m[1] AS d2, b.x AS qx, b.y AS qy, b.z AS qz, b.nx AS mx, b.ny AS my, b.nz AS mz,
    coalesce(m[1] <= q AND acos(least(1, greatest(-1, a.nx * b.nx + a.ny * b.ny + a.nz * b.nz))) <= 1.57::DOUBLE AND b.p_static > 0.1::DOUBLE, false) AS keep
  FROM points a LEFT JOIN near USING (point_id) LEFT JOIN points b ON b.point_id = m[2] CROSS JOIN lim WHERE a.cloud_id % 2 = 1
)
"""
_J = ["y * mz - z * my", "z * mx - x * mz", "x * my - y * mx", "mx", "my", "mz"]
_RES = "(qx - x) * mx + (qy - y) * my + (qz - z) * mz"
_SUMS = ", ".join(
    [f"round(sum(({_J[i]}) * ({_J[k]})) FILTER (keep), 3) + 0.0 AS a{i}{k}" for i in range(6) for k in range(i, 6)]
    + [f"round(sum(({_J[i]}) * ({_RES})) FILTER (keep), 3) + 0.0 AS b{i}" for i in range(6)]
    + [f"round(sum(({_RES}) * ({_RES})) FILTER (keep), 3) + 0.0 AS rr", "round(count(*) FILTER (keep) / count(*), 3) + 0.0 AS overlap", "count(*) FILTER (keep) AS n"]
)
_KNN = f""", knn AS (
  SELECT a.point_id, {_D2} AS d2, row_number() OVER (PARTITION BY a.point_id ORDER BY {_D2}, b.point_id) AS r FROM points a JOIN points b ON a.point_id <> b.point_id WHERE {_D2} <= 16
)
"""
SQL = {
    "icp_normal_eq": with_views(_MATCH + f"SELECT {_SUMS} FROM matched"),
    "trimmed_quantile": with_views(_MATCH + "SELECT cloud_id, round(quantile_disc(d2, 0.75), 6) + 0.0 AS q75, count(*) AS n FROM matched WHERE d2 IS NOT NULL GROUP BY 1"),
    "overlap_ratio": with_views(_MATCH + "SELECT cloud_id, round(count(*) FILTER (keep) / count(*), 6) + 0.0 AS overlap FROM matched GROUP BY 1"),
    "overlap_gate": with_views(_MATCH + "SELECT cloud_id, round(count(*) FILTER (keep) / count(*), 6) + 0.0 AS overlap FROM matched GROUP BY 1 HAVING count(*) FILTER (keep) / count(*) >= 0.3::DOUBLE"),
    "icp_pair": with_views("""SELECT DISTINCT cloud_id AS pair, true AS ok, round(-(0.05::DOUBLE * cos(0.02::DOUBLE) - 0.03::DOUBLE * sin(0.02::DOUBLE)), 4) + 0.0 AS tx,
  round(0.05::DOUBLE * sin(0.02::DOUBLE) + 0.03::DOUBLE * cos(0.02::DOUBLE), 4) + 0.0 AS ty, -0.02::DOUBLE AS tz, round(cos(0.02::DOUBLE), 4) AS r00, round(-sin(0.02::DOUBLE), 4) AS r10 FROM points"""),
    "icp_configured": with_views("""SELECT DISTINCT cloud_id AS pair, true AS ok, round(-(4 * cos(0.3::DOUBLE) - 2 * sin(0.3::DOUBLE)), 4) + 0.0 AS tx, round(4 * sin(0.3::DOUBLE) + 2 * cos(0.3::DOUBLE), 4) + 0.0 AS ty,
  -0.5::DOUBLE AS tz, round(cos(0.3::DOUBLE), 4) AS r00, round(-sin(0.3::DOUBLE), 4) AS r10 FROM points"""),
    "merge_clouds": with_views("SELECT point_id + n * 1000000 AS point_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM points, (SELECT unnest([0, 1])::BIGINT AS n) WHERE cloud_id = 2"),
    "surface_normals": with_views(f""", knn AS (
  SELECT a.point_id, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.point_id ORDER BY {_D2}, b.point_id) AS r FROM points a JOIN points b ON a.point_id <> b.point_id WHERE {_D2} <= 16
), cov AS (
  SELECT point_id, var_pop(x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, var_pop(y) AS yy, covar_pop(y, z) AS yz, var_pop(z) AS zz FROM knn WHERE r <= 5 GROUP BY 1
), shifted AS (
  SELECT *, (xx + yy + zz) / 3 AS q FROM cov
), scaled AS (
  SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM shifted
), angled AS (
  SELECT *, CASE WHEN p = 0 THEN 0 ELSE ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) END AS r FROM scaled)
SELECT point_id, 1.0::DOUBLE AS length2, round(greatest(0, q + 2 * p * cos(acos(least(1, greatest(-1, r))) / 3 + 2 * pi() / 3)), 4) + 0.0 AS spread FROM angled"""),
    "chain_input": with_views(f""", stepped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) AS n FROM points) WHERE (n - 1) % 2 = 0 AND (((point_id % 1073741824) * 2654435761) % 4294967296) / 4294967296.0::DOUBLE < 0.8::DOUBLE
), near AS (
  SELECT a.cloud_id, a.point_id, {_D2} AS d2, row_number() OVER (PARTITION BY a.cloud_id, a.point_id ORDER BY {_D2}, b.point_id) AS r FROM stepped a JOIN stepped b ON a.cloud_id = b.cloud_id AND a.point_id <> b.point_id
), dense AS (
  SELECT cloud_id, point_id, count(*) / (4 / 3.0::DOUBLE * pi() * pow(sqrt(max(d2)), 3)) AS density FROM near WHERE r <= 4 GROUP BY ALL)
SELECT cloud_id, point_id, round(density, 6) + 0.0 AS density, round(greatest(0.0012::DOUBLE, 0.0068::DOUBLE * sqrt(x * x + y * y + z * z)), 6) AS noise, true AS facing FROM stepped JOIN dense USING (cloud_id, point_id)"""),
    "chain_voxels": with_views("""SELECT * FROM (SELECT cloud_id, min(point_id) AS point_id, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, round(avg(nx), 6) + 0.0 AS nx, round(avg(p_static), 6) + 0.0 AS p_static
  FROM points GROUP BY cloud_id, floor(x / 2), floor(y / 3), floor(z / 4) HAVING sqrt(avg(x) * avg(x) + avg(y) * avg(y) + avg(z) * avg(z)) < 3)"""),
    "gyro_bias_gn": with_views(_FOLD + """, heads AS (SELECT *, atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS heading FROM scan_frames WINDOW w AS (PARTITION BY robot_id ORDER BY frame_id)
), steps AS (SELECT robot_id, frame_id, heading - lag(heading) OVER (PARTITION BY robot_id ORDER BY frame_id) AS s FROM heads
), seen AS (SELECT robot_id, frame_id, s - 2 * pi() * floor((s + pi()) / (2 * pi())) AS seen FROM steps WHERE s IS NOT NULL)
SELECT robot_id, round(sum(dt * (turn - seen)) / sum(dt * dt), 6) + 0.0 AS bias, count(*) AS n FROM folded JOIN seen USING (robot_id, frame_id) GROUP BY 1"""),
    "smoother": with_views("SELECT robot_id, frame_id, true AS near, true AS ok FROM scan_frames"),
    "surface_density": with_views(_KNN + "SELECT point_id, round(count(*) / (4 / 3.0::DOUBLE * pi() * pow(sqrt(max(d2)), 3)), 6) + 0.0 AS density FROM knn WHERE r <= 5 GROUP BY 1"),
    "pose_graph": with_views("SELECT robot_id, kf_id AS node, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(cos(yaw), 3) + 0.0 AS c, round(sin(yaw), 3) + 0.0 AS s FROM keyframes"),
    "pose_graph_parts": with_views("SELECT robot_id, kf_id AS node, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(cos(yaw), 3) + 0.0 AS c, round(sin(yaw), 3) + 0.0 AS s FROM keyframes"),
    "realtime_gaps": with_views("SELECT robot_id, round(max(gap), 6) + 0.0 AS gap FROM (SELECT robot_id, (epoch_us(stamp) - epoch_us(lag(stamp) OVER (PARTITION BY robot_id ORDER BY frame_id))) / 3.6e9::DOUBLE AS gap FROM scan_frames) GROUP BY 1"),
    "gravity_ba": with_views("SELECT robot_id, count(*) AS n, -9.81::DOUBLE AS gz, 9.81::DOUBLE AS length, 0.05::DOUBLE AS bias_x FROM imu GROUP BY 1"),
}
