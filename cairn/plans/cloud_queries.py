"""Cloud queries: projections, filters, whole maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.functions.extrinsics import body_laser
from cairn.operators import clouds as C

from .views import points, poses, r6, with_views

XYZ = ("x", "y", "z")


def _xyz(df, *more):
    return df.select("cloud_id", "point_id", *[r6(c).alias(c) for c in (*XYZ, *more)])


def map_static_world(spark, d):
    """All submaps in one frame, static points only, as voxels of half a metre."""
    world = C.whole_map(points(spark, d), poses(spark), 0.5)
    return C.voxel_grid(world, 0.5).select("vx", "vy", "vz", "n", *[r6(c).alias(c) for c in (*XYZ, "p_static")])


def rigid_transform(spark, d):
    return _xyz(C.whole_map(points(spark, d), poses(spark)), "nx", "ny", "nz")


def whole_map_rebuild(spark, d):
    return _xyz(C.whole_map(points(spark, d), poses(spark), 0.55, skip_last=True))


def spherical_project(spark, d):
    return C.spherical(points(spark, d)).select("point_id", *[r6(c).alias(c) for c in ("r", "inclination", "azimuth")])


def pose_inverse_roundtrip(spark, d):
    moved = C.move(points(spark, d).join(poses(spark), "cloud_id"), F.col("pose"))
    return _xyz(C.move(moved, P.inverse(F.col("pose"))))


def relative_poses(spark, d):
    """Relative pose of each submap that has points to the next one, as translation and turn."""
    a = poses(spark).join(points(spark, d).select("cloud_id").distinct(), "cloud_id")
    b = a.select((F.col("cloud_id") - 1).alias("cloud_id"), F.col("pose").alias("next"))
    t = a.join(b, "cloud_id").withColumn("rel", P.relative(F.col("pose"), F.col("next")))
    return t.select("cloud_id", r6(F.col("rel")[3]).alias("tx"), r6(F.col("rel")[7]).alias("ty"), r6(P.rotation_angle(F.col("rel"))).alias("angle"))


def seed_crop(spark, d):
    """Points of a submap within 20 m of the origin after the move into its pose's frame: the seed of a new submap."""
    return _xyz(C.max_distance(C.move(points(spark, d).join(poses(spark), "cloud_id"), P.inverse(F.col("pose"))), 20.0))


def descriptor_defaults(spark, d):
    bare = points(spark, d).withColumn("p_static", F.when(F.col("point_id") % 3 > 0, F.col("p_static"))).drop("p_dynamic")
    return C.default_descriptors(bare).select("point_id", *[r6(c).alias(c) for c in ("p_static", "p_dynamic", "dynamic_ratio")])


def body_points(spark, d):
    """Points of the laser in the robot's own frame, by the default mounting."""
    mount = F.array(*[F.lit(float(v)) for v in body_laser()[0].reshape(-1)])
    return _xyz(C.move(points(spark, d), mount))


def clouds_union(spark, d):
    """A cloud with normals and one with a density, as one with what both have."""
    p = points(spark, d)
    odd = p.where("cloud_id % 2 = 1").select("cloud_id", "point_id", *XYZ, C.radius().alias("density"), "p_static")
    return _xyz(C.concatenate([p.where("cloud_id % 2 = 0").drop("p_dynamic"), odd]), "p_static")


def observed(spark, d):
    return C.observation_direction(points(spark, d), (1.0, 2.0, 3.0))


QUERIES = {
    "map_static_world": map_static_world,
    "rigid_transform": rigid_transform,
    "whole_map_rebuild": whole_map_rebuild,
    "spherical_project": spherical_project,
    "pose_inverse_roundtrip": pose_inverse_roundtrip,
    "relative_poses": relative_poses,
    "body_points": body_points,
    "clouds_union": clouds_union,
    "range_crop": lambda s, d: _xyz(C.max_distance(points(s, d), 2.0)),
    "near_range_cut": lambda s, d: _xyz(C.min_distance(points(s, d), 1.0)),
    "seed_crop": seed_crop,
    "bounded_map": lambda s, d: _xyz(C.bounded(C.whole_map(points(s, d), poses(s)), (20.0, 0.0, 0.0), (12.0, 6.0, 2.0))),
    "static_keep": lambda s, d: _xyz(C.static_only(points(s, d), 0.55), "p_static"),
    "descriptor_defaults": descriptor_defaults,
    "fix_step_sample": lambda s, d: _xyz(C.fix_step(points(s, d), 5)),
    "hash_sample": lambda s, d: _xyz(C.random_sample(points(s, d), 0.2, seed=3)),
    "density_thin": lambda s, d: _xyz(C.max_density(points(s, d).withColumn("density", C.radius() * 20), 10.0)),
    "voxel_grid": lambda s, d: C.voxel_grid(points(s, d), 0.5).select("vx", "vy", "vz", "n", *[r6(c).alias(c) for c in (*XYZ, "p_static")]),
    "max_point_count": lambda s, d: _xyz(C.max_point_count(points(s, d), 100)),
    "sensor_noise": lambda s, d: C.sensor_noise(points(s, d)).select("point_id", r6("noise").alias("noise")),
    "observation_direction": lambda s, d: observed(s, d).select("point_id", *[r6(c).alias(c) for c in ("ox", "oy", "oz")]),
    "orient_normals": lambda s, d: C.orient_normals(observed(s, d)).select("point_id", *[r6(c).alias(c) for c in ("nx", "ny", "nz")]),
    "scan_sanity": lambda s, d: _xyz(C.sane_clouds(points(s, d), 50)),
    "filter_chain": lambda s, d: _xyz(C.apply_chain(points(s, d), [
        ("FixStepSamplingDataPointsFilter", {"startStep": 2}), ("RandomSamplingDataPointsFilter", {"prob": 0.8}), ("MaxDistDataPointsFilter", {"maxDist": 3.0, "dim": -1})])),
}

_R = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in XYZ)
_U = "((point_id % 1073741824) * 2654435761 + {} * 40503) % 4294967296 / 4294967296.0::DOUBLE"
_WORLD = """, world AS (
  SELECT cloud_id, point_id, c * x - s * y + t AS x, s * x + c * y AS y, z, c * nx - s * ny AS nx, s * nx + c * ny AS ny, nz, p_static FROM points JOIN poses USING (cloud_id)
)
"""
_VOXELS = """SELECT CAST(floor(x / 0.5::DOUBLE) AS BIGINT) AS vx, CAST(floor(y / 0.5::DOUBLE) AS BIGINT) AS vy, CAST(floor(z / 0.5::DOUBLE) AS BIGINT) AS vz, count(*) AS n,
  round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, round(avg(p_static), 6) + 0.0 AS p_static FROM {} GROUP BY 1, 2, 3"""
_KEYED = f"SELECT cloud_id, point_id, {_R}"

#: The laser's place on the robot, as numbers.
_MOUNT = body_laser()[0]
_BODY = ", ".join(f"round({' + '.join(f'{_MOUNT[r, c]:.17g}::DOUBLE * {a}' for c, a in enumerate(XYZ))} + {_MOUNT[r, 3]:.17g}::DOUBLE, 6) + 0.0 AS {name}" for r, name in enumerate(XYZ))
SQL = {
    "body_points": with_views(f"SELECT cloud_id, point_id, {_BODY} FROM points"),
    "clouds_union": with_views(f"{_KEYED}, round(p_static, 6) + 0.0 AS p_static FROM points"),
    "map_static_world": with_views(_WORLD + _VOXELS.format("world WHERE p_static > 0.5")),
    "rigid_transform": with_views(_WORLD + f"{_KEYED}, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz FROM world"),
    "whole_map_rebuild": with_views(_WORLD + f"{_KEYED} FROM world WHERE p_static > 0.55 AND cloud_id < (SELECT max(cloud_id) FROM poses)"),
    "spherical_project": with_views("""SELECT point_id, round(r, 6) + 0.0 AS r, round(CASE WHEN r > 0 THEN acos(z / r) ELSE 0 END, 6) + 0.0 AS inclination, round(atan2(y, x), 6) + 0.0 AS azimuth
  FROM (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM points)"""),
    "pose_inverse_roundtrip": with_views(f"{_KEYED} FROM points JOIN poses USING (cloud_id)"),
    "relative_poses": with_views("""SELECT cloud_id, round(5 * cos(0.1::DOUBLE * cloud_id), 6) + 0.0 AS tx, round(-5 * sin(0.1::DOUBLE * cloud_id), 6) + 0.0 AS ty, round(0.1::DOUBLE, 6) AS angle
  FROM (SELECT DISTINCT cloud_id FROM points) a WHERE cloud_id + 1 IN (SELECT cloud_id FROM points)"""),
    "range_crop": with_views(f"{_KEYED} FROM points WHERE sqrt(x * x + y * y + z * z) < 2"),
    "near_range_cut": with_views(f"{_KEYED} FROM points WHERE sqrt(x * x + y * y + z * z) > 1"),
    "seed_crop": with_views(f", seed AS (SELECT cloud_id, point_id, c * (x - t) + s * y AS x, -s * (x - t) + c * y AS y, z FROM points JOIN poses USING (cloud_id)) {_KEYED} FROM seed WHERE sqrt(x * x + y * y + z * z) < 20"),
    "bounded_map": with_views(_WORLD + f"{_KEYED} FROM world WHERE x BETWEEN 8 AND 32 AND y BETWEEN -6 AND 6 AND z BETWEEN -2 AND 2"),
    "static_keep": with_views(f"{_KEYED}, round(p_static, 6) + 0.0 AS p_static FROM points WHERE p_static > 0.55"),
    "descriptor_defaults": with_views("SELECT point_id, round(CASE WHEN point_id % 3 > 0 THEN p_static ELSE 0.45::DOUBLE END, 6) + 0.0 AS p_static, 0.55::DOUBLE AS p_dynamic, 0.0::DOUBLE AS dynamic_ratio FROM points"),
    "fix_step_sample": with_views(f"{_KEYED} FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) AS n FROM points) WHERE (n - 1) % 5 = 0"),
    "hash_sample": with_views(f"{_KEYED} FROM points WHERE {_U.format(3)} < 0.2::DOUBLE"),
    "density_thin": with_views(f"{_KEYED} FROM (SELECT *, sqrt(x * x + y * y + z * z) * 20 AS density FROM points) WHERE density <= 10 OR {_U.format(0)} < 10.0::DOUBLE / density"),
    "voxel_grid": with_views(_VOXELS.format("points")),
    "max_point_count": with_views(f"{_KEYED} FROM (SELECT * FROM points ORDER BY {_U.format(0)}, point_id LIMIT 100)"),
    "sensor_noise": with_views("SELECT point_id, round(greatest(0.0012::DOUBLE, 0.0068::DOUBLE * sqrt(x * x + y * y + z * z)), 6) + 0.0 AS noise FROM points"),
    "observation_direction": with_views("SELECT point_id, round(1 - x, 6) + 0.0 AS ox, round(2 - y, 6) + 0.0 AS oy, round(3 - z, 6) + 0.0 AS oz FROM points"),
    "orient_normals": with_views("""SELECT point_id, round(f * nx, 6) + 0.0 AS nx, round(f * ny, 6) + 0.0 AS ny, round(f * nz, 6) + 0.0 AS nz
  FROM (SELECT *, CASE WHEN nx * (1 - x) + ny * (2 - y) + nz * (3 - z) < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS f FROM points)"""),
    "scan_sanity": with_views(f"{_KEYED} FROM points WHERE cloud_id IN (SELECT cloud_id FROM points GROUP BY 1 HAVING count(*) >= 50)"),
    "filter_chain": with_views(f"""{_KEYED} FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY point_id) AS n FROM points)
  WHERE (n - 1) % 2 = 0 AND {_U.format(0)} < 0.8::DOUBLE AND sqrt(x * x + y * y + z * z) < 3"""),
}
