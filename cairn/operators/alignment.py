"""Alignment of inertial folds with a laser's poses in windows: velocities, gravity and scale, by orthogonal elimination.

A window is a group of its own, so a robot's path spreads over tasks. Each interval between two frames gives six equations on the
velocities of its ends, gravity and scale; velocities are eliminated from frame to frame, in time and memory that follow the window's
length, and four unknowns are left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "robot_id long, window long, n long, ok boolean, gx double, gy double, gz double, scale double, frame_ids array<long>, velocities array<array<double>>"


def interval_rows(poses: np.ndarray, dp: np.ndarray, dv: np.ndarray, dt: np.ndarray, mount: np.ndarray) -> np.ndarray:
    """Six equations of each interval, 6 x 11: on (velocity before, velocity after, gravity, scale), and the right side."""
    n = len(dt)
    lever = np.linalg.inv(mount)[:3, 3]
    turned = poses[:, :3, :3] @ mount[:3, :3].T
    back, t = turned[:-1].transpose(0, 2, 1), dt[:, None, None]
    a = np.zeros((n, 6, 11))
    eye = np.eye(3)
    a[:, :3, :3], a[:, :3, 6:9] = -t * eye, -0.5 * t * t * back
    a[:, :3, 9] = np.einsum("nij,nj->ni", back, poses[1:, :3, 3] - poses[:-1, :3, 3])
    a[:, :3, 10] = dp - np.einsum("nij,njk,k->ni", back, poses[1:, :3, :3] - poses[:-1, :3, :3], lever)
    a[:, 3:, :3], a[:, 3:, 3:6], a[:, 3:, 6:9] = -eye, back @ turned[1:], -t * back
    a[:, 3:, 10] = dv
    return a


def eliminate(rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(triangles of each velocity, what is left on gravity, scale and the right side) by orthogonal steps: squares of the equations, which
    lose what intervals of seconds among intervals of days say, are not formed."""
    triangles, carried = [], np.zeros((0, 8))
    for own in rows:
        # the rows carried from before have this interval's first velocity, not its second
        stacked = np.vstack((np.hstack((carried[:, :3], np.zeros((len(carried), 3)), carried[:, 3:])), own))
        r = np.linalg.qr(stacked, mode="r")
        triangles.append(r[:3])
        carried = r[3:, 3:]
    r = np.linalg.qr(carried, mode="r")
    triangles.append(np.hstack((r[:3, :3], np.zeros((3, 3)), r[:3, 3:])))
    return triangles, r[3:, 3:]


def velocities_of(triangles: list[np.ndarray], border: np.ndarray) -> np.ndarray:
    """Velocities from the last to the first, given gravity and scale."""
    x = np.zeros((len(triangles) + 1, 3))
    for i in range(len(triangles) - 1, -1, -1):
        r = triangles[i]
        x[i] = np.linalg.solve(r[:, :3], r[:, 10] - r[:, 3:6] @ x[i + 1] - r[:, 6:10] @ border)
    return x[:-1]


def align_window(poses: np.ndarray, dp: np.ndarray, dv: np.ndarray, dt: np.ndarray, mount: np.ndarray, g: float, scaled: bool) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(velocities in the bodies' frames, gravity, scale), or None if gravity is off by more than 1 or the scale is negative. As solve.linear_alignment, whose matrix is dense."""
    triangles, left = eliminate(interval_rows(poses, dp, dv, dt, mount))

    def border(free: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """The least-squares offset + free @ y."""
        q, r = np.linalg.qr(left[:, :4] @ free)
        return offset + free @ np.linalg.solve(r, q.T @ (left[:, 4] - left[:, :4] @ offset))

    one = np.array([0, 0, 0, 1.0])
    found = border(np.eye(4) if scaled else np.eye(4)[:, :3], one * (not scaled))
    gravity, scale = found[:3], found[3]
    if abs(np.linalg.norm(gravity) - g) > 1 or scale < 0:
        return None
    for _ in range(4):
        d = gravity / np.linalg.norm(gravity)
        side = np.cross(d, np.eye(3)[int(np.argmin(np.abs(d)))])
        side /= np.linalg.norm(side)
        plane = np.zeros((4, 3 if scaled else 2))
        plane[:3, 0], plane[:3, 1] = side, np.cross(d, side)
        if scaled:
            plane[3, 2] = 1
        found = border(plane, np.append(g * d, 0.0 if scaled else 1.0))
        gravity, scale = found[:3], found[3]
    return (velocities_of(triangles, found), gravity * g / np.linalg.norm(gravity), float(scale)) if scale >= 0 else None


def align_windows(frames: DataFrame, width: int = 50, stride: int = 10, body_laser: np.ndarray | None = None, g: float = 9.81, scaled: bool = True) -> DataFrame:
    """A row for each window of `width` frames, `stride` apart: ok, gravity, scale, frame_ids and velocities (null where not ok).

    frames(robot_id, frame_id, pose, dp, dv, dt): a laser's pose, and the inertial fold since the frame before (null at the first). The last
    windows of a robot are shorter; those of fewer than four frames, or whose system has no single solution, aren't ok.
    """
    by = Window.partitionBy("robot_id").orderBy("frame_id")
    rows = frames.select("robot_id", "frame_id", "pose", "dp", "dv", "dt", (F.row_number().over(by) - 1).alias("nth"))
    first = F.greatest(F.lit(0), F.ceil((F.col("nth") - (width - 1)) / stride))
    rows = rows.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col("nth") / stride))))
    mount = np.eye(4) if body_laser is None else body_laser

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("frame_id")
        found = None
        if len(own) >= 4:
            vectors = [np.array(own[c].tolist()[1:], float).reshape(-1, 3) for c in ("dp", "dv")]
            try:
                found = align_window(np.array(own["pose"].tolist(), float).reshape(-1, 4, 4), *vectors, own["dt"].to_numpy(float)[1:], mount, g, scaled)
            except np.linalg.LinAlgError:
                found = None
        v, gravity, scale = found or (None, [None] * 3, None)
        return pd.DataFrame({"robot_id": [own["robot_id"].iloc[0]], "window": [own["window"].iloc[0]], "n": [len(own)], "ok": [found is not None], "gx": [gravity[0]], "gy": [gravity[1]], "gz": [gravity[2]],
                             "scale": [scale], "frame_ids": [own["frame_id"].tolist()], "velocities": [None if v is None else v.tolist()]}).astype({c: float for c in ("gx", "gy", "gz", "scale")})

    return rows.groupBy("robot_id", "window").applyInPandas(run, RESULT)
