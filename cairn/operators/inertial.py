"""Propagation of inertial states with full rotations, as a scan over (pose, velocity, time).

A sample that lasts dt is the element (exp(w dt), a dt, a dt^2 / 2, dt); elements follow one another by
(R1 R2, v1 + R1 v2, p1 + v1 t2 + R1 p2, t1 + t2), which is associative. So a robot is cut into buckets of time: each task scans one
bucket, the buckets' totals, a row each, are scanned for the robot, and what lies before a bucket is put before its elements by a join.
Gravity comes in at the end, as it does not turn: p + v t + g t^2 / 2.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.sources.shared import materialize

from .groups import apply_to_groups, starts
from .motion import HOUR, exps_so3
from .temporal import micros

#: Seconds of a bucket: some 100,000 samples of a fast sensor.
BUCKET_S = 600
ELEMENT = "pose array<double>, v array<double>, t double"
Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def follow(a: Element, b: Element) -> Element:
    """Elements b after elements a, as (rotations, velocities, places, times)."""
    turned = lambda x: np.einsum("nij,nj->ni", a[0], x)
    return a[0] @ b[0], a[1] + turned(b[1]), a[2] + a[1] * b[3][:, None] + turned(b[2]), a[3] + b[3]


def scan(e: Element, first: np.ndarray) -> Element:
    """Each element after all before it in its group, by doubling steps; first: where each group begins."""
    at = np.arange(len(e[3]))
    own = at - np.repeat(first, np.diff(np.append(first, len(at))))
    e, step = tuple(x.copy() for x in e), 1
    while (rest := at[own >= step]).size:
        for x, y in zip(e, follow(tuple(x[rest - step] for x in e), tuple(x[rest] for x in e)), strict=True):
            x[rest] = y
        step *= 2
    return e


def _columns(e: Element) -> dict:
    poses = np.tile(np.eye(4), (len(e[3]), 1, 1))
    poses[:, :3, :3], poses[:, :3, 3] = e[0], e[2]
    return {"pose": poses.reshape(-1, 16).tolist(), "v": e[1].tolist(), "t": e[3]}


def _before(e: Element, first: np.ndarray) -> Element:
    """Each element's predecessor; that of a group's first one is nothing."""
    nothing = (np.eye(3), np.zeros(3), np.zeros(3), 0.0)
    before = tuple(np.roll(x, 1, axis=0) for x in e)
    for x, none in zip(before, nothing, strict=True):
        x[first] = none
    return before


def _in_buckets(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each sample what its bucket holds before it, and of each bucket's last row (event_id null) its total."""
    first = starts(rows, ["robot_id", "bucket"])
    last = np.append(first[1:], len(rows)) - 1
    dt, w, a = rows["dt"].to_numpy(), rows[["wx", "wy", "wz"]].to_numpy(), rows[["ax", "ay", "az"]].to_numpy()
    whole = scan((exps_so3(w * dt[:, None])[0], a * dt[:, None], 0.5 * a * dt[:, None] ** 2, dt), first)
    parts = tuple(np.concatenate((x, y[last])) for x, y in zip(_before(whole, first), whole, strict=True))
    ids = pd.array([*rows["event_id"], *[None] * len(last)], dtype="Int64")
    ends = rows.iloc[last]
    return pd.DataFrame({**{c: np.concatenate((rows[c].to_numpy(), ends[c].to_numpy())) for c in ("robot_id", "bucket", "stamp")}, "event_id": ids, **_columns(parts)})


def _over_buckets(rows: pd.DataFrame) -> pd.DataFrame:
    first = starts(rows, ["robot_id"])
    poses = np.array(rows["pose"].tolist(), float).reshape(-1, 4, 4)
    e = _before(scan((poses[:, :3, :3], np.array(rows["v"].tolist(), float).reshape(-1, 3), poses[:, :3, 3], rows["t"].to_numpy()), first), first)
    return pd.DataFrame({"robot_id": rows["robot_id"], "bucket": rows["bucket"], **_columns(e)})


def after(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """(pose, v, t) of b after a, as columns."""
    (pose, v, t), (pose2, v2, t2) = a, b
    turned = P.rotate(pose, v2[0], v2[1], v2[2])
    moved = P.let(F.array(P.product(pose, pose2), v), lambda m: F.transform(m[0], lambda x, i: x + F.when(i == 3, m[1][0] * t2).when(i == 7, m[1][1] * t2).when(i == 11, m[1][2] * t2).otherwise(0.0)))
    return moved, F.array(*[v[i] + turned[i] for i in range(3)]), t + t2


def propagate(samples: DataFrame, anchors: DataFrame, gravity: float = -9.81, unit: float = HOUR, bucket_s: int = BUCKET_S) -> DataFrame:
    """(robot_id, event_id, stamp, pose, v) at each sample from a robot's anchor on; the first of these has the anchor's own state.

    samples(robot_id, event_id, stamp, wx, wy, wz, ax, ay, az), each in force until the next; anchors(robot_id, stamp, pose, v), one a
    robot: a corrected state is a new anchor. unit: microseconds of the unit of time of rates. Robots without an anchor
    are left out. A call of Python takes the samples of some whole
    buckets, at least one, however long the robot has run.
    """
    started = samples.join(anchors.select("robot_id", F.col("stamp").alias("start")), "robot_id").where("stamp >= start").drop("start")
    rows = materialize(started.withColumn("bucket", F.floor(micros("stamp") / (bucket_s * 1_000_000))))
    # the first sample of the next bucket that has one: a row a bucket
    firsts = rows.groupBy("robot_id", "bucket").agg(F.min("stamp").alias("first"))
    nexts = firsts.withColumn("next", F.lead("first").over(Window.partitionBy("robot_id").orderBy("bucket"))).drop("first")
    by = Window.partitionBy("robot_id", "bucket").orderBy("stamp", "event_id")
    timed = rows.join(nexts, ["robot_id", "bucket"]).withColumn("until", F.coalesce(F.lead("stamp").over(by), "next", "stamp"))
    timed = timed.withColumn("dt", (micros("until") - micros("stamp")) / unit).drop("until", "next")
    parts = materialize(apply_to_groups(timed, ["robot_id", "bucket"], ["stamp", "event_id"], _in_buckets, f"robot_id long, bucket long, event_id long, stamp timestamp_ntz, {ELEMENT}"))
    ahead = apply_to_groups(parts.where("event_id is null").select("robot_id", "bucket", "pose", "v", "t"), ["robot_id"], ["bucket"], _over_buckets, f"robot_id long, bucket long, {ELEMENT}")
    e = lambda df, name, *more: df.select("robot_id", *more, F.struct("pose", "v", "t").alias(name))
    own = e(parts.where("event_id is not null"), "own", "bucket", "event_id", "stamp").join(e(ahead, "head", "bucket"), ["robot_id", "bucket"])
    at = own.join(anchors.select("robot_id", F.struct("pose", "v", F.lit(0.0).alias("t")).alias("anchor")), "robot_id")
    parts_of = lambda s: (F.col(f"{s}.pose"), F.col(f"{s}.v"), F.col(f"{s}.t"))
    pose, v, t = after(parts_of("head"), parts_of("own"))
    at = at.select("robot_id", "event_id", "stamp", "anchor", F.struct(pose.alias("pose"), v.alias("v"), t.alias("t")).alias("moved"))
    pose, v, t = after(parts_of("anchor"), parts_of("moved"))
    at = at.select("robot_id", "event_id", "stamp", pose.alias("pose"), v.alias("v"), t.alias("t"))
    fallen = F.transform("pose", lambda x, i: x + F.when(i == 11, 0.5 * gravity * F.col("t") * F.col("t")).otherwise(0.0))
    return at.select("robot_id", "event_id", "stamp", fallen.alias("pose"), F.transform("v", lambda x, i: x + F.when(i == 2, gravity * F.col("t")).otherwise(0.0)).alias("v"))
