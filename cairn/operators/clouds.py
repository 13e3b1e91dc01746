"""Point filters and projections: each takes a DataFrame of points and returns one.

Points have point_id, x, y, z and any descriptors; filters work per cloud_id where they rank.
Random choices go by a hash of point_id, so they are the same on every run and every cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import pose as P

from .neighbours import knn_all
from .registration import surface_normals

#: Fixed values of the hash behind `uniform`.
SPREAD, SEED_STEP, MODULUS = 2654435761, 40503, 1 << 32


def uniform(point_id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on point_id and seed alone."""
    return F.pmod(F.pmod(point_id, F.lit(1 << 30)) * SPREAD + seed * SEED_STEP, F.lit(MODULUS)) / float(MODULUS)


def radius() -> Column:
    return F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))


def move(points: DataFrame, pose: Column, normals: bool = False) -> DataFrame:
    """p' = R p + t, and n' = R n for normals."""
    new = dict(zip("xyz", P.transform(pose, "x", "y", "z"), strict=True))
    if normals:
        new |= dict(zip(("nx", "ny", "nz"), P.rotate(pose, "nx", "ny", "nz"), strict=True))
    return points.withColumns(new)


def spherical(points: DataFrame) -> DataFrame:
    """Adds r, inclination acos(z/r) and azimuth atan2(y, x); a point at the origin gets inclination 0."""
    r = radius()
    return points.withColumns({"r": r, "inclination": F.when(r > 0, F.acos(F.col("z") / r)).otherwise(0.0), "azimuth": F.atan2("y", "x")})


def default_descriptors(points: DataFrame, prior_static: float = 0.45, prior_dynamic: float = 0.55) -> DataFrame:
    """Adds p_static, p_dynamic and dynamic_ratio where missing, and fills nulls."""
    for name, value in (("p_static", prior_static), ("p_dynamic", prior_dynamic), ("dynamic_ratio", 0.0)):
        old = F.col(name) if name in points.columns else F.lit(None).cast("double")
        points = points.withColumn(name, F.coalesce(old, F.lit(value)))
    return points


def fix_step(points: DataFrame, step: int = 5) -> DataFrame:
    """Every step-th point of a cloud by point_id, from the first."""
    by = Window.partitionBy("cloud_id").orderBy("point_id")
    return points.withColumn("_n", F.row_number().over(by)).where((F.col("_n") - 1) % step == 0).drop("_n")


def random_sample(points: DataFrame, prob: float = 0.8, seed: int = 0) -> DataFrame:
    return points.where(uniform(F.col("point_id"), seed) < prob)


def max_density(points: DataFrame, limit: float, seed: int = 0) -> DataFrame:
    """Keeps a denser point with a chance of limit / density."""
    return points.where((F.col("density") <= limit) | (uniform(F.col("point_id"), seed) < limit / F.col("density")))


def voxel_grid(points: DataFrame, size: float, means: list[str] = ["p_static"]) -> DataFrame:
    """One row per voxel: index, number of points, centroid and mean descriptors. One hash aggregation."""
    cell = {f"v{a}": F.floor(F.col(a) / size) for a in "xyz"}
    return points.groupBy(*[c.alias(n) for n, c in cell.items()]).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "z", *means)])


def voxel_filter(points: DataFrame, size: tuple[float, float, float]) -> DataFrame:
    """One point per cloud and voxel, as a filter in a chain: the least point_id, and means of places and descriptors."""
    cells = [F.floor(F.col(a) / v).alias(f"_v{a}") for a, v in zip("xyz", size, strict=True)]
    means = [F.avg(c).alias(c) for c, kind in points.dtypes if kind in ("double", "float")]
    out = points.groupBy("cloud_id", *cells).agg(F.min("point_id").alias("point_id"), *means)
    return out.select(*[c for c in points.columns if c in out.columns])


def surface_normal(points: DataFrame, knn: int = 10, radius: float = 2.0, normals: bool = True, densities: bool = True) -> DataFrame:
    """Adds or replaces normals and density, from the knn nearest points of the same cloud; radius is where the search begins.
    Points of clouds with fewer than three others keep what they have, or get nulls."""
    fitted = surface_normals(knn_all(points, knn, radius, ["cloud_id"]), ("cloud_id",))
    new = [c for c, wanted in (("nx", normals), ("ny", normals), ("nz", normals), ("density", densities)) if wanted]
    fitted = fitted.select("cloud_id", "point_id", *[F.col(c).alias(f"_{c}") for c in new])
    old = {c: F.col(c) if c in points.columns else F.lit(None).cast("double") for c in new}
    return points.join(fitted.hint("merge"), ["cloud_id", "point_id"], "left").withColumns({c: F.coalesce(f"_{c}", old[c]) for c in new}).drop(*[f"_{c}" for c in new])


def concatenate(clouds: list[DataFrame]) -> DataFrame:
    """Clouds as one, with the descriptors that all of them have."""
    shared = [c for c in clouds[0].columns if all(c in o.columns for o in clouds)]
    out = clouds[0].select(*shared)
    for o in clouds[1:]:
        out = out.unionByName(o.select(*shared))
    return out


#: Bins that hashes are counted in.
HASH_BINS = 1 << 16


def max_point_count(points: DataFrame, count: int, seed: int = 0, bins: int = HASH_BINS) -> DataFrame:
    """The `count` points of smallest hash, in two passes: hashes are counted in bins, whole bins are kept, and only the bin at the limit is sorted."""
    if count <= 0:
        return points.where("false")
    hashed = points.withColumn("_u", uniform(F.col("point_id"), seed)).withColumn("_bin", F.floor(F.col("_u") * bins))
    left = count
    for r in hashed.groupBy("_bin").count().orderBy("_bin").collect():  # a row a bin
        if r["count"] > left:
            edge = hashed.where(F.col("_bin") == r["_bin"]).orderBy("_u", "point_id").limit(left)
            return hashed.where(F.col("_bin") < r["_bin"]).unionByName(edge).drop("_u", "_bin")
        left -= r["count"]
    return points


def max_distance(points: DataFrame, limit: float, axis: str | None = None) -> DataFrame:
    """Within limit of the origin, by radius or along one axis."""
    return points.where(radius() < limit if axis is None else F.abs(F.col(axis)) < limit)


def min_distance(points: DataFrame, limit: float) -> DataFrame:
    return points.where(radius() > limit)


def static_only(points: DataFrame, threshold: float = 0.8) -> DataFrame:
    return points.where(F.col("p_static") > threshold)


def bounded(points: DataFrame, centre: tuple[float, float, float], half: tuple[float, float, float]) -> DataFrame:
    """Inside an axis-aligned box."""
    ok = F.lit(True)
    for a, c, h in zip("xyz", centre, half, strict=True):
        ok = ok & F.col(a).between(c - h, c + h)
    return points.where(ok)


def sensor_noise(points: DataFrame, gain: float = 0.0068, offset: float = 0.0012) -> DataFrame:
    """Adds the noise of a range sensor: greater of an offset and a share of the range."""
    return points.withColumn("noise", F.greatest(F.lit(offset), gain * radius()))


def observation_direction(points: DataFrame, sensor: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    return points.withColumns({f"o{a}": F.lit(s) - F.col(a) for a, s in zip("xyz", sensor, strict=True)})


def orient_normals(points: DataFrame) -> DataFrame:
    """Turns normals toward the sensor, by the observation direction."""
    away = F.col("nx") * F.col("ox") + F.col("ny") * F.col("oy") + F.col("nz") * F.col("oz") < 0
    return points.withColumns({n: F.when(away, -F.col(n)).otherwise(F.col(n)) for n in ("nx", "ny", "nz")})


def sane_clouds(points: DataFrame, least: int = 1000) -> DataFrame:
    """Points of clouds that have enough of them."""
    return points.join(points.groupBy("cloud_id").count().where(F.col("count") >= least).select("cloud_id"), "cloud_id", "left_semi")


def whole_map(points: DataFrame, poses: DataFrame, static: float | None = None, skip_last: bool = False, begin: int | None = None, post: list[tuple[str, dict]] | None = None) -> DataFrame:
    """All submaps in one frame: poses joined by cloud_id, points moved and filtered, then the chain `post`. skip_last leaves out
    the newest submap, begin those before it: as a map is rebuilt after an optimization."""
    if begin is not None:
        poses = poses.where(F.col("cloud_id") >= begin)
    if skip_last:
        poses = poses.join(poses.agg(F.max("cloud_id").alias("_last")), F.col("cloud_id") < F.col("_last")).drop("_last")
    moved = move(points.join(poses, "cloud_id"), F.col("pose"), "nx" in points.columns).drop("pose")
    return apply_chain(moved if static is None else static_only(moved, static), post or [])


#: Filters by the names that chains in configuration files use.
FILTERS: dict[str, Callable[..., DataFrame]] = {
    "FixStepSamplingDataPointsFilter": lambda p, startStep=5, **_: fix_step(p, int(startStep)),
    "RandomSamplingDataPointsFilter": lambda p, prob=0.75, **_: random_sample(p, float(prob)),
    "MaxDensityDataPointsFilter": lambda p, maxDensity=10, **_: max_density(p, float(maxDensity)),
    "SimpleSensorNoiseDataPointsFilter": lambda p, **_: sensor_noise(p),
    "ObservationDirectionDataPointsFilter": lambda p, x=0, y=0, z=0, **_: observation_direction(p, (float(x), float(y), float(z))),
    "OrientNormalsDataPointsFilter": lambda p, **_: orient_normals(p),
    "SurfaceNormalDataPointsFilter": lambda p, knn=5, keepNormals=1, keepDensities=0, radius=2, **_: surface_normal(p, int(knn), float(radius), bool(float(keepNormals)), bool(float(keepDensities))),
    "VoxelGridDataPointsFilter": lambda p, vSizeX=1, vSizeY=1, vSizeZ=1, **_: voxel_filter(p, (float(vSizeX), float(vSizeY), float(vSizeZ))),
    "MaxPointCountDataPointsFilter": lambda p, maxCount=1000, **_: max_point_count(p, int(maxCount)),
    "MaxDistDataPointsFilter": lambda p, maxDist=1, dim=-1, **_: max_distance(p, float(maxDist), None if int(dim) < 0 else "xyz"[int(dim)]),
    "MinDistDataPointsFilter": lambda p, minDist=1, **_: min_distance(p, float(minDist)),
}


def apply_chain(points: DataFrame, chain: list[tuple[str, dict]]) -> DataFrame:
    """Filters of a chain, one after the other."""
    for name, params in chain:
        if name not in FILTERS:
            raise ValueError(f"unknown filter {name}")
        points = FILTERS[name](points, **params)
    return points
