"""Scan registration: point-to-plane ICP, configured as chains are.

Pairs of clouds are registered side by side. Small ones, whose sizes are checked, run whole in a task each;
for larger ones every iteration is a grid join and one aggregation of 28 sums a pair (`register_many`), whatever
the size of a cloud. Both follow the same definitions:

Matches of a reading point are the knn nearest reference points within max_dist; a match is kept if its squared
distance is among the smallest `ratio` of them (the value of that rank, to 1/100000 in Spark), its normals differ by
at most max_angle, and the reference point is static enough. Overlap is the share of reading points with a kept match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.sources.shared import materialize

from .motion import exp_so3, log_so3
from .neighbours import at_places, k_nearest

#: Points of a pair that is registered in a task of its own, some 100 bytes each.
TASK_POINTS = 400_000
#: Distances up to which all are computed at once; beyond, points meet by cells.
ALL_DISTANCES = 1_000_000
#: Distances of two clouds up to which the nearest of all is searched; beyond, or for more than one neighbour beyond the former number, points meet by cells.
FEW_DISTANCES = 50_000_000
#: Distances that are computed at once on the way to the nearest of all.
SLICE_DISTANCES = 1 << 17
#: Rows near a place that are remembered while it moves.
CANDIDATES = 12


@dataclass(frozen=True)
class IcpParams:
    """reading_filters and reference_filters are chains (clouds.apply_chain) that callers run before."""

    knn: int = 1
    max_dist: float = 2.0
    ratio: float = 0.75
    max_angle: float = 1.57
    min_static: float = 0.1
    max_iterations: int = 40
    min_rotation: float = 0.001
    min_translation: float = 0.01
    smooth: int = 2
    max_rotation_norm: float = 0.8
    max_translation_norm: float = 30.0
    reading_filters: tuple = ()
    reference_filters: tuple = ()


def configured(sections: dict[str, list[tuple[str, dict]]]) -> IcpParams:
    """Parameters from a chain file's sections (formats.parse_sections), by the names that such files use."""
    made: dict = {"reading_filters": tuple(sections.get("readingDataPointsFilters", ())), "reference_filters": tuple(sections.get("referenceDataPointsFilters", ()))}
    known = {
        "KDTreeMatcher": {"knn": ("knn", int), "maxDist": ("max_dist", float)}, "TrimmedDistOutlierFilter": {"ratio": ("ratio", float)},
        "SurfaceNormalOutlierFilter": {"maxAngle": ("max_angle", float)}, "GenericDescriptorOutlierFilter": {"threshold": ("min_static", float)},
        "DifferentialTransformationChecker": {"minDiffRotErr": ("min_rotation", float), "minDiffTransErr": ("min_translation", float), "smoothLength": ("smooth", int)},
        "CounterTransformationChecker": {"maxIterationCount": ("max_iterations", int)},
        "BoundTransformationChecker": {"maxRotationNorm": ("max_rotation_norm", float), "maxTranslationNorm": ("max_translation_norm", float)},
        "PointToPlaneErrorMinimizer": {}, "NullInspector": {}, "NullLogger": {},
    }
    # an outlier filter that a file leaves out is off
    outliers = {n for n, _ in sections.get("outlierFilters", ())}
    off = {"TrimmedDistOutlierFilter": ("ratio", 1.0), "SurfaceNormalOutlierFilter": ("max_angle", 4.0), "GenericDescriptorOutlierFilter": ("min_static", -1.0)}
    made |= dict(v for n, v in off.items() if n not in outliers)
    for section in ("matcher", "outlierFilters", "errorMinimizer", "transformationCheckers", "inspector", "logger"):
        for name, params in sections.get(section, ()):
            if name not in known:
                raise ValueError(f"unknown part {name} of {section}")
            for key, value in params.items():
                if key in known[name]:
                    field, kind = known[name][key]
                    made[field] = kind(value)
    return IcpParams(**made)


class ConvergenceError(Exception):
    """The transform left its bounds: callers drop the scan."""


def matches(reading: DataFrame, reference: DataFrame, p: IcpParams, by: list[str] | None = None) -> DataFrame:
    """A row for each reading point and match, or one without: reading's columns, the match's place and normal (q*, m*), nth, d2, keep, any (of the point's)."""
    named = {"d2": "d2", "point_id": "match_id", "x": "qx", "y": "qy", "z": "qz", "nx": "mx", "ny": "my", "nz": "mz", "p_static": "ref_static"}
    near = k_nearest(reading, reference.select(*(by or []), *[c for c in named if c != "d2"]), p.knn, p.max_dist, by=by)
    found = F.when(F.size("near") > 0, F.transform("near", lambda m: F.struct(*[m[c].alias(n) for c, n in named.items()])))
    joined = at_places(reading, near, by=by, how="left").withColumn("found", found).drop("near")
    limit = joined.select(*(by or []), F.explode("found.d2").alias("d2")).groupBy(*(by or [])).agg(F.percentile_approx("d2", p.ratio, 100_000).alias("limit"))
    joined = joined.join(limit, by, "left") if by else joined.join(F.broadcast(limit), F.lit(True))
    angle = lambda m: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("nx") * m.mx + F.col("ny") * m.my + F.col("nz") * m.mz)))
    kept = F.transform("found", lambda m: F.struct(m.alias("m"), ((m.d2 <= F.col("limit")) & (angle(m) <= p.max_angle) & (m.ref_static > p.min_static)).alias("keep")))
    rows = joined.withColumn("found", kept).withColumn("any", F.coalesce(F.exists("found", lambda c: c.keep), F.lit(False)))
    return rows.select(*reading.columns, "any", F.posexplode_outer("found").alias("nth", "c")).select(*reading.columns, "nth", "c.m.*", F.coalesce("c.keep", F.lit(False)).alias("keep"), "any")


def normal_equations(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each `by`): the upper triangle a00..a55 of J'J, b0..b5 of J'r, rr, n and overlap of the kept matches."""
    x, y, z, a, b, c = (F.col(n) for n in ("x", "y", "z", "mx", "my", "mz"))
    j = [y * c - z * b, z * a - x * c, x * b - y * a, a, b, c]  # rotation, then translation
    r = (F.col("qx") - x) * a + (F.col("qy") - y) * b + (F.col("qz") - z) * c
    kept = lambda e: F.sum(F.when(F.col("keep"), e))
    sums = [kept(j[i] * j[k]).alias(f"a{i}{k}") for i in range(6) for k in range(i, 6)] + [kept(j[i] * r).alias(f"b{i}") for i in range(6)]
    point = F.coalesce("nth", F.lit(0)) == 0
    return matched.groupBy(*(by or [])).agg(*sums, kept(r * r).alias("rr"), F.count_if("keep").alias("n"), (F.count_if(point & F.col("any")) / F.count_if(point)).alias("overlap"))


def solve_step(row) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation that the normal equations ask for."""
    a = np.zeros((6, 6))
    for i in range(6):
        for k in range(i, 6):
            a[i, k] = a[k, i] = row[f"a{i}{k}"] or 0.0
    b = np.array([row[f"b{i}"] or 0.0 for i in range(6)])
    step = np.linalg.lstsq(a, b, rcond=1e-10)[0]
    return exp_so3(step[:3]), step[3:]


def check_bounds(t: np.ndarray, start: np.ndarray, p: IcpParams) -> None:
    moved = np.linalg.inv(start) @ t
    if np.linalg.norm(log_so3(moved[:3, :3])) > p.max_rotation_norm or np.linalg.norm(moved[:3, 3]) > p.max_translation_norm:
        raise ConvergenceError("the transform left its bounds")


def settled(steps: list[tuple[float, float]], p: IcpParams) -> bool:
    last = steps[-p.smooth :]
    return len(last) == p.smooth and np.mean([s[0] for s in last]) < p.min_rotation and np.mean([s[1] for s in last]) < p.min_translation


def next_step(row, t: np.ndarray, start: np.ndarray, steps: list, p: IcpParams) -> tuple[np.ndarray, list, bool]:
    """(transform, steps so far, settled) after one iteration's sums; ConvergenceError out of bounds or without matches."""
    if not row["n"]:
        raise ConvergenceError("no matches")
    r, move = solve_step(row)
    delta = np.eye(4)
    delta[:3, :3], delta[:3, 3] = r, move
    t = delta @ t
    check_bounds(t, start, p)
    steps = [*steps, (float(np.linalg.norm(log_so3(r))), float(np.linalg.norm(move)))]
    return t, steps, settled(steps, p)


def _in_cells(a: np.ndarray, b: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, squared distance) of up to k pairs for each row of a within the radius, nearest first; ties to the smaller row of b."""
    low = np.minimum(a.min(0), b.min(0)) - 2 * radius
    span = np.floor((np.maximum(a.max(0), b.max(0)) - low) / radius).astype(np.int64) + 3
    step = np.array([span[1] * span[2], span[2], 1])
    key = lambda x: (np.floor((x - low) / radius).astype(np.int64) * step).sum(1)
    own, keys = key(a), key(b)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    # the three cells of a row along the last axis are one run of keys
    rows = np.array([i * step[0] + j * step[1] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    wanted = own[:, None] + rows
    first, last = np.searchsorted(keys, wanted - 1), np.searchsorted(keys, wanted + 1, side="right")
    n = (last - first).sum(1)
    cut, found = [0], []
    for end in np.searchsorted(np.cumsum(n), np.arange(1, int(n.sum()) // ALL_DISTANCES + 1) * ALL_DISTANCES).tolist() + [len(a)]:
        cut += [max(end, cut[-1])]
    for s, e in zip(cut, cut[1:], strict=False):
        f, c = first[s:e].ravel(), (last - first)[s:e].ravel()
        left, right = np.repeat(np.arange(s, e), n[s:e]), order[np.repeat(f - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        d2 = ((a[left] - b[right]) ** 2).sum(1)
        good = d2 <= radius * radius
        left, right, d2 = left[good], right[good], d2[good]
        if k == 1 and len(left):
            head = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
            least = np.minimum.reduceat(d2, head)
            rows = np.where(d2 == np.repeat(least, np.diff(np.append(head, len(left)))), right, len(b))
            found.append((left[head], np.minimum.reduceat(rows, head), least))
            continue
        rank = np.lexsort((right, d2, left))
        left, right, d2 = left[rank], right[rank], d2[rank]
        nth = np.arange(len(left)) - np.searchsorted(left, left)
        found.append((left[nth < k], right[nth < k], d2[nth < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_rows(a: np.ndarray, b: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of b, squared distances) of the k nearest within the radius for each row of a, nearest first, ties to the smaller row; 0 and inf
    where there are fewer. Rings of cells, as in neighbours: only rows that lack some go on with cells of twice the size."""
    at, d2 = np.zeros((len(a), k), np.int64), np.full((len(a), k), np.inf)
    rest, span = np.arange(len(a)), float(max(np.ptp(b, axis=0).max(), 1e-9))
    ring = min(radius, max(span * (k / len(b)) ** (1 / 3), span / 1e5, radius / 1e5))
    while len(rest):
        left, right, gap = _in_cells(a[rest], b, k, ring)
        nth = np.arange(len(left)) - np.searchsorted(left, left)
        at[rest[left], nth], d2[rest[left], nth] = right, gap
        if ring >= radius:
            break
        rest = rest[np.bincount(left, minlength=len(rest)) < k]
        ring = min(2 * ring, radius)
    return at, d2


def nearest_of_all(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of b, squared distance) of the nearest for each row of a, ties to the smaller row, for finite coordinates.

    Products of matrices find the candidates: rows that are as near as the nearest but for rounding. Of these, distances are computed as they are.
    """
    at, d2 = np.empty(len(a), np.int64), np.empty(len(a))
    size = (b * b).sum(1)
    slack = 1e-13 * (np.abs(a).max() + np.abs(b).max()) ** 2
    turned, many = np.ascontiguousarray(-2 * b.T), max(1, SLICE_DISTANCES // len(b))
    for s in range(0, len(a), many):
        own = a[s : s + many]
        gap = own @ turned
        gap += size
        left, right = np.nonzero(gap <= gap.min(axis=1, keepdims=True) + slack)
        exact = ((own[left] - b[right]) ** 2).sum(1)
        head = np.searchsorted(left, np.arange(len(own)))
        least = np.minimum.reduceat(exact, head)
        at[s : s + many] = np.minimum.reduceat(np.where(exact == least[left], right, len(b)), head)
        d2[s : s + many] = least
    return at, d2


class NearestAsTheyMove:
    """nearest_of_all of places that move a little from call to call, where it is within the radius; beyond, any row that is as far.

    A place keeps its CANDIDATES nearest rows from where they were searched. Other rows were as far as the last of these at least, and are nearer now by no more than
    the place has moved since, so a candidate that is nearer than that is the nearest of all. Places for which that doesn't hold are searched again.
    """

    def __init__(self, b: np.ndarray, radius: float):
        self.b, self.radius, self.k = b, radius, min(CANDIDATES, len(b))
        self.size, self.turned = (b * b).sum(1), np.ascontiguousarray(-2 * b.T)
        self.most, self.places = float(np.abs(b).max()), None

    def _search(self, rows: np.ndarray, a: np.ndarray) -> None:
        own, many = a[rows], max(1, SLICE_DISTANCES // len(self.b))
        length, slack = (own * own).sum(1), 1e-13 * (float(np.abs(own).max()) + self.most) ** 2
        for s in range(0, len(rows), many):
            at = rows[s : s + many]
            gap = own[s : s + many] @ self.turned
            gap += self.size
            near = np.argpartition(gap, self.k - 1, axis=1)[:, : self.k] if self.k < len(self.b) else np.broadcast_to(np.arange(self.k), gap.shape)
            last = np.take_along_axis(gap, near, axis=1).max(axis=1) + length[s : s + many] - slack
            self.near[at] = np.sort(near, axis=1)
            self.beyond[at] = np.sqrt(np.maximum(last, 0)) if self.k < len(self.b) else np.inf
        self.places[rows] = own
        for found, axis in zip(self.found, self.b.T, strict=True):
            found[rows] = axis[self.near[rows]]

    def _nearest(self, rows: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of b, squared distance, whether it is the nearest for certain) by the candidates of these rows."""
        own, gap = a[rows], 0.0
        for found, axis in zip(self.found, own.T, strict=True):
            away = (found if len(rows) == len(a) else found[rows]) - axis[:, None]
            away *= away
            gap = gap + away
        best = gap.argmin(axis=1)  # candidates are in the order of rows, so ties go to the smaller one
        d2 = gap[np.arange(len(rows)), best]
        bound = self.beyond[rows] - np.sqrt(((own - self.places[rows]) ** 2).sum(1))
        bound -= np.where(np.isfinite(bound), 1e-9 * (1 + np.abs(bound)), 0)
        return self.near[rows, best], d2, (np.sqrt(d2) < bound) | (bound > self.radius)

    def __call__(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.arange(len(a))
        if self.places is None:
            self.places, self.found, self.beyond = np.empty_like(a), [np.empty((len(a), self.k)) for _ in range(3)], np.empty(len(a))
            self.near = np.empty((len(a), self.k), np.int64)
            self._search(every, a)
        at, d2, sure = self._nearest(every, a)
        if not sure.all():
            rest = np.flatnonzero(~sure)
            self._search(rest, a)
            at[rest], d2[rest], sure = self._nearest(rest, a)
            if not sure.all():
                rest = rest[~sure]
                at[rest], d2[rest] = nearest_of_all(a[rest], self.b)
        return at, d2


def icp(reading: np.ndarray, read_normals: np.ndarray, reference: np.ndarray, normals: np.ndarray, static: np.ndarray, start: np.ndarray | None = None, p: IcpParams = IcpParams()) -> tuple[np.ndarray, float]:
    """The registration of two clouds in memory; distances of small ones are all computed, larger ones are searched by cells."""
    start = np.eye(4) if start is None else start
    t, overlap, steps = start.copy(), 0.0, []
    k, finite = min(p.knn, len(reference)), bool(np.isfinite(reference).all())
    nearest = NearestAsTheyMove(reference, p.max_dist) if k == 1 and finite else None
    for _ in range(p.max_iterations):
        moved, turned = reading @ t[:3, :3].T + t[:3, 3], read_normals @ t[:3, :3].T
        if len(moved) * len(reference) > (FEW_DISTANCES if k == 1 else ALL_DISTANCES):
            at, d2 = nearest_rows(moved, reference, k, p.max_dist)
        elif nearest is not None and np.isfinite(moved).all():
            at, d2 = (x[:, None] for x in nearest(moved))
        else:
            at, d2 = np.empty((len(moved), k), np.int64), np.empty((len(moved), k))
            for a in range(0, len(moved), 256):
                gap = ((moved[a : a + 256, None] - reference[None]) ** 2).sum(axis=2)
                at[a : a + 256] = np.argsort(gap, axis=1, kind="stable")[:, :k]
                d2[a : a + 256] = np.take_along_axis(gap, at[a : a + 256], axis=1)
        near = d2 <= p.max_dist**2
        if not near.any():
            raise ConvergenceError("no matches")
        angle = np.arccos(np.clip((turned[:, None] * normals[at]).sum(axis=2), -1, 1))
        some = d2[near]
        rank = max(math.ceil(len(some) * p.ratio - 1), 0)  # as np.quantile's inverted_cdf, which costs small clouds more than the rest
        keep = near & (d2 <= np.partition(some, rank)[rank]) & (angle <= p.max_angle) & (static[at] > p.min_static)
        overlap = float(keep.any(axis=1).mean())
        own, q, n = moved[np.nonzero(keep)[0]], reference[at[keep]], normals[at[keep]]
        (x, y, z), (a, b, c) = own.T, n.T
        j, r = np.column_stack((y * c - z * b, z * a - x * c, x * b - y * a, n)), ((q - own) * n).sum(axis=1)
        a, b = j.T @ j, j.T @ r
        row = {f"a{i}{m}": a[i, m] for i in range(6) for m in range(i, 6)} | {f"b{i}": b[i] for i in range(6)} | {"n": len(own)}
        t, steps, done = next_step(row, t, start, steps, p)
        if done:
            break
    return t, overlap


def register_many(readings: DataFrame, references: DataFrame, starts: DataFrame, p: IcpParams = IcpParams()) -> DataFrame:
    """(pair, ok, overlap, t) for pairs of any size: each iteration is a join and an aggregation for all pairs that still move; their states are small tables."""
    state = "pair long, start array<double>, t array<double>, overlap double, steps array<array<double>>, done boolean, ok boolean"
    now = materialize(starts.select("pair", F.col("start"), F.col("start").alias("t"), F.lit(0.0).alias("overlap"), F.array().cast("array<array<double>>").alias("steps"), F.lit(False).alias("done"), F.lit(True).alias("ok")))
    sums = [f"a{i}{k}" for i in range(6) for k in range(i, 6)] + [f"b{i}" for i in range(6)] + ["n", "overlap"]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                start, t = (np.array(r[c], float).reshape(4, 4) for c in ("start", "t"))
                steps, overlap = [tuple(x) for x in r["steps"]], float(r["new_overlap"] or 0.0)
                try:
                    t, steps, done = next_step({c: r[c] if r[c] == r[c] else None for c in sums if c != "overlap"}, t, start, steps, p)
                    out.append((r["pair"], list(r["start"]), t.reshape(-1).tolist(), overlap, [list(x) for x in steps], done or len(steps) >= p.max_iterations, True))
                except ConvergenceError:
                    out.append((r["pair"], list(r["start"]), list(r["t"]), 0.0, [list(x) for x in steps], True, False))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in state.split(", ")])

    while now.where("not done").take(1):
        open_ = now.where("not done")
        moved = readings.join(open_.select("pair", "t"), "pair")
        moved = moved.withColumns(dict(zip(["x", "y", "z", "nx", "ny", "nz"], [*P.transform(F.col("t"), "x", "y", "z"), *P.rotate(F.col("t"), "nx", "ny", "nz")], strict=True))).drop("t")
        found = normal_equations(matches(moved, references, p, ["pair"]), ["pair"]).withColumnRenamed("overlap", "new_overlap")
        waiting = open_.join(found, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        now = materialize(now.where("done").unionByName(waiting.mapInPandas(step, state)))
    return now.select("pair", "ok", "overlap", F.when(F.col("ok"), F.col("t")).alias("t"))


def register(reading: DataFrame, reference: DataFrame, start: np.ndarray | None = None, p: IcpParams = IcpParams()) -> tuple[np.ndarray, float]:
    """(transform, overlap) that moves one reading onto its reference, of any size: in a task if they fit, else by `register_many`."""
    pair = lambda df: df.withColumn("pair", F.lit(0).cast("long"))
    cells = [float(v) for v in (np.eye(4) if start is None else start).reshape(-1)]
    starts = reading.sparkSession.range(1).select(F.col("id").alias("pair"), F.array(*map(F.lit, cells)).alias("start"))
    row = register_pairs(pair(reading), pair(reference), p, starts).first()
    if not row.ok:
        raise ConvergenceError("no matches, or the transform left its bounds")
    return np.array(row.t).reshape(4, 4), row.overlap


def register_pairs(readings: DataFrame, references: DataFrame, p: IcpParams = IcpParams(), starts: DataFrame | None = None, task_distances: int | None = None) -> DataFrame:
    """(pair, ok, overlap, t array<double>): registers the reading of each pair to its reference, pairs in parallel.

    Both sides: pair, point_id, x, y, z, nx, ny, nz, p_static. starts(pair, start): guesses, the identity where there is none. A
    registration that fails gives ok = false, as does an empty cloud. Pairs of more than TASK_POINTS points, or of more than task_distances
    distances if that is given, go by `register_many`.
    """
    cells = ["pair", "point_id", "x", "y", "z", "nx", "ny", "nz", "p_static"]
    sizes = [side.groupBy("pair").agg(F.count("*").alias(n)) for side, n in ((readings, "n_a"), (references, "n_b"))]
    every = sizes[0].join(sizes[1], "pair", "full").na.fill(0)
    if starts is not None:
        every = every.join(starts.select("pair", "start"), "pair", "left").withColumn("start", F.coalesce("start", P.identity()))
    else:
        every = every.withColumn("start", P.identity())
    large = F.col("n_a") + F.col("n_b") > TASK_POINTS if task_distances is None else F.col("n_a") * F.col("n_b") > task_distances
    every = materialize(every.withColumn("large", large))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("point_id"), b.sort_values("point_id")
        pair = (a if len(a) else b)["pair"].iloc[0]
        xyz, n = ["x", "y", "z"], ["nx", "ny", "nz"]
        try:
            if not len(a) or not len(b):
                raise ConvergenceError("an empty cloud")
            t, overlap = icp(a[xyz].to_numpy(), a[n].to_numpy(), b[xyz].to_numpy(), b[n].to_numpy(), b["p_static"].to_numpy(), np.array(a["start"].iloc[0], float).reshape(4, 4), p)
            return pd.DataFrame({"pair": [pair], "ok": [True], "overlap": [overlap], "t": [t.reshape(-1).tolist()]})
        except ConvergenceError:
            return pd.DataFrame({"pair": [pair], "ok": [False], "overlap": [0.0], "t": [None]})

    small = every.where("not large").select("pair", "start")
    a, b = (side.select(*cells).join(small, "pair").toDF(*cells, "start") for side in (readings, references))  # renamed, as both sides may come from one table
    out = a.groupBy("pair").cogroup(b.groupBy("pair")).applyInPandas(run, "pair long, ok boolean, overlap double, t array<double>")
    large = every.where("large").select("pair", "start")
    return out.unionByName(register_many(readings.select(*cells), references.select(*cells), large, p)) if large.take(1) else out


def overlap_gate(results: DataFrame, least: float = 0.2) -> DataFrame:
    """Registrations that succeeded with enough overlap: the scans of the others are dropped."""
    return results.where(F.col("ok") & (F.col("overlap") >= least))


def merge_clouds(first: DataFrame, second: DataFrame, p: IcpParams = IcpParams(), start: np.ndarray | None = None) -> DataFrame:
    """Two clouds in the first one's frame: the second is registered to the first and moved there; p's chains thin both for the registration."""
    from .clouds import apply_chain, move

    t, _ = register(apply_chain(second, list(p.reading_filters)), apply_chain(first, list(p.reference_filters)), start, p)
    return first.unionByName(move(second, F.array(*[F.lit(float(v)) for v in t.reshape(-1)]), normals=True), allowMissingColumns=True)


def bootstrap(scans: list[DataFrame], cloud: DataFrame, p: IcpParams = IcpParams(), rounds: int = 6) -> np.ndarray | None:
    """Pose of a robot on a known map, once `rounds` scans in a row have registered, each from the result before; a failure starts over. None if too few do."""
    t, done = np.eye(4), 0
    for scan in scans:
        try:
            t, done = register(scan, cloud, t, p)[0], done + 1
        except ConvergenceError:
            t, done = np.eye(4), 0
        if done >= rounds:
            return t
    return None


def surface_normals(neighbours: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, point_id, nx, ny, nz, density) from knn rows (l, r, d2): the smallest eigenvector of the neighbours' covariance.

    The covariance is one hash aggregation; only its six numbers per point go to numpy, in batches.
    density is k over the volume of the sphere through the farthest neighbour, spread the variance along the normal.
    """
    x, y, z = (F.col(f"r.{a}") for a in "xyz")
    cov = neighbours.groupBy(*[F.col(f"l.{c}").alias(c) for c in (*by, "point_id")]).agg(
        F.covar_pop(x, x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, y).alias("yy"), F.covar_pop(y, z).alias("yz"), F.covar_pop(z, z).alias("zz"),
        F.count("*").alias("k"), F.sqrt(F.max("d2")).alias("reach"))

    def run(frames):
        for pdf in frames:
            m = pdf[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy().reshape(-1, 3, 3)
            n = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.zeros((0, 3))
            n = n * np.where(n[np.arange(len(n)), np.abs(n).argmax(axis=1)] < 0, -1, 1)[:, None] if len(n) else n
            volume = 4 / 3 * np.pi * pdf["reach"].to_numpy() ** 3
            yield pd.DataFrame({**{c: pdf[c] for c in (*by, "point_id")}, "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2],
                                "density": pdf["k"].to_numpy() / np.where(volume > 0, volume, np.inf), "spread": np.einsum("ni,nij,nj->n", n, m, n)})

    return cov.mapInPandas(run, "".join(f"{c} long, " for c in (*by, "point_id")) + "nx double, ny double, nz double, density double, spread double")
