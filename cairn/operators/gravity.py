"""Gravity and accelerometer bias of robots from still samples, by sums: no robot's samples come together in a task.

Each round is one join and one aggregation: 21 sums a robot of what its samples say at the state that was tried last (two angles of
gravity's direction, three of bias). A robot's step is solved on its row of sums; a step that costs more is taken
back and damped. All robots go side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.sources.shared import materialize

from .motion import exp_so3
from .solve import HUBER_GRAVITY

PAIRS = [(i, k) for i in range(5) for k in range(i, 5)]
SUMS = [f"a{i}{k}" for i, k in PAIRS] + [f"b{i}" for i in range(5)] + ["cost"]
STATE = "robot_id long, n long, base array<double>, x array<double>, tried array<double>, sums array<double>, damping double, taken int, failed int, done boolean, pull array<double>, by0 array<double>, by1 array<double>"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def _pull(base: np.ndarray, angles: np.ndarray, g: float) -> np.ndarray:
    """What a still sensor feels in the world's frame: minus gravity."""
    return base @ exp_so3(np.array([angles[0], angles[1], 0.0])) @ np.array([0, 0, g])


def _with_pull(row: dict, g: float) -> dict:
    base, x, h = np.array(row["base"], float).reshape(3, 3), np.array(row["tried"], float), 1e-6
    sides = [(_pull(base, x[:2] + d, g) - _pull(base, x[:2] - d, g)) / (2 * h) for d in (np.array([h, 0]), np.array([0, h]))]
    return row | {"pull": _pull(base, x[:2], g).tolist(), "by0": sides[0].tolist(), "by1": sides[1].tolist()}


def _begin(g: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                d = -np.array([r["mx"], r["my"], r["mz"]])
                length = np.linalg.norm(d)
                d = d / length if length > 0 else np.array([0, 0, -1.0])
                axis = np.cross([0, 0, -1.0], d)
                s = np.linalg.norm(axis)
                base = exp_so3(axis / s * np.arctan2(s, -d[2])) if s > 1e-9 else (np.eye(3) if d[2] < 0 else np.diag([1.0, -1.0, -1.0]))
                start = {"robot_id": r["robot_id"], "n": r["n"], "base": base.reshape(-1).tolist(), "x": [0.0] * 5, "tried": [0.0] * 5, "sums": None, "damping": 1e-4, "taken": 0, "failed": 0, "done": False}
                out.append(_with_pull(start, g))
            yield pd.DataFrame(out, columns=NAMES)

    return run


def _advance(g: float, prior: float, iterations: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                tried, sums = np.array(r["tried"], float), np.array([r[c] for c in SUMS], float)
                sums[-1] += prior * tried[2:] @ tried[2:]
                old = None if r["sums"] is None else np.array(r["sums"], float)
                row = {c: r[c] for c in NAMES}
                if old is None or sums[-1] <= old[-1]:
                    gain = None if old is None else old[-1] - sums[-1]
                    row |= {"x": tried.tolist(), "sums": sums.tolist(), "failed": 0, "taken": r["taken"] + (old is not None)}
                    row["damping"] = r["damping"] if old is None else max(r["damping"] / 10, 1e-9)
                    row["done"] = row["taken"] >= iterations or gain is not None and gain <= 1e-12 * (1 + sums[-1])
                else:
                    row |= {"damping": r["damping"] * 10, "failed": r["failed"] + 1, "done": r["failed"] + 1 >= 8}
                x, kept = np.array(row["x"], float), np.array(row["sums"], float)
                a, b = np.zeros((5, 5)), kept[len(PAIRS) : -1].copy()
                for (i, k), v in zip(PAIRS, kept, strict=False):
                    a[i, k] = a[k, i] = v
                a[2:, 2:] += prior * np.eye(3)
                b[2:] -= prior * x[2:]
                row["tried"] = (x + np.linalg.solve(a + row["damping"] * (np.diag(np.diag(a)) + 1e-9 * np.eye(5)), b)).tolist()
                out.append(_with_pull(row, g))
            yield pd.DataFrame(out, columns=NAMES)

    return run


def gravity_by_sums(samples: DataFrame, g: float = 9.81, prior: float = 300.0, weight: float = 100.0, iterations: int = 10, huber: float = HUBER_GRAVITY) -> DataFrame:
    """(robot_id, n, gx, gy, gz, bias_x, bias_y, bias_z, cost): as solve.gravity_and_bias, from samples(robot_id, pose, ax, ay, az) of still sensors at known rotations."""
    turned = P.rotate(F.col("pose"), "ax", "ay", "az")
    means = samples.groupBy("robot_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(n) for c, n in zip(turned, ("mx", "my", "mz"), strict=True)])
    state = materialize(means.mapInPandas(_begin(g), STATE))
    back = lambda c: [sum((F.col("pose")[4 * j + i] * F.col(c)[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    while state.where("not done").take(1):
        rows = samples.join(state.where("not done").select("robot_id", "tried", "pull", "by0", "by1"), "robot_id")
        rows = rows.select("robot_id", F.array(*back("by0")).alias("u"), F.array(*back("by1")).alias("v"), F.array(*[p + F.col("tried")[2 + i] - F.col(f"a{a}") for i, (p, a) in enumerate(zip(back("pull"), "xyz", strict=True))]).alias("e"))
        q = weight * sum((F.col("e")[i] * F.col("e")[i] for i in range(3)), F.lit(0.0))
        rows = rows.withColumn("q", q).withColumn("w", weight * F.when(F.col("q") <= huber**2, 1.0).otherwise(huber / F.sqrt("q")))
        unit = lambda k: [F.lit(1.0 if i == k - 2 else 0.0) for i in range(3)]
        column = lambda k: [F.col("uv"[k])[i] for i in range(3)] if k < 2 else unit(k)
        dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
        e = [F.col("e")[i] for i in range(3)]
        cost = F.when(F.col("q") <= huber**2, F.col("q")).otherwise(2 * huber * F.sqrt("q") - huber**2)
        sums = rows.groupBy("robot_id").agg(
            *[F.sum(F.col("w") * dot(column(i), column(k))).alias(f"a{i}{k}") for i, k in PAIRS], *[F.sum(-F.col("w") * dot(column(k), e)).alias(f"b{k}") for k in range(5)], F.sum(cost).alias("cost"))
        state = materialize(state.where("done").unionByName(state.where("not done").join(sums, "robot_id").mapInPandas(_advance(g, prior, iterations), STATE)))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(r["robot_id"], r["n"], *(-_pull(np.array(r["base"], float).reshape(3, 3), np.array(r["x"], float), g)), *np.array(r["x"], float)[2:], float(r["sums"][-1])) for r in rows.to_dict("records")]
            yield pd.DataFrame(out, columns=["robot_id", "n", "gx", "gy", "gz", "bias_x", "bias_y", "bias_z", "cost"])

    return state.mapInPandas(finish, "robot_id long, n long, gx double, gy double, gz double, bias_x double, bias_y double, bias_z double, cost double")
