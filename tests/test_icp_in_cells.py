"""Nearest rows in memory by rings of cells, and registrations that fit a task by points."""

import numpy as np

from cairn.operators import registration as R


def test_nearest_rows_match_brute_force():
    rng = np.random.default_rng(7)
    b = np.round(np.concatenate((rng.normal(0, 0.05, (500, 3)), rng.normal(0, 3, (100, 3)), np.zeros((30, 3)))), 3)
    a = np.concatenate((b[::3], rng.normal(0, 4, (80, 3)), [[50.0, 0, 0]]))
    gap = ((a[:, None] - b[None]) ** 2).sum(2)
    for k, radius in ((1, 2.0), (3, 0.7)):
        at, d2 = R.nearest_rows(a, b, k, radius)
        order = np.argsort(gap, axis=1, kind="stable")[:, :k]
        wanted = np.take_along_axis(gap, order, axis=1)
        near = wanted <= radius**2
        assert (np.isinf(d2) == ~near).all()
        assert (at[near] == order[near]).all() and np.allclose(d2[near], wanted[near], rtol=0, atol=0)


def test_a_pair_of_many_distances_and_few_points_runs_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(R, "register_many", None)
    rng = np.random.default_rng(8)
    xyz = rng.normal(0, 1.2, (2500, 3))
    n = rng.normal(0, 1, (2500, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    frame = lambda shift: spark.createDataFrame([(1, i, *map(float, p + shift), *map(float, q), 1.0) for i, (p, q) in enumerate(zip(xyz, n, strict=True))], "pair long, point_id long, x double, y double, z double, nx double, ny double, nz double, p_static double")
    row = R.register_pairs(frame(np.array([0.02, -0.01, 0.01])), frame(np.zeros(3)), R.IcpParams()).first()
    assert row.ok and np.allclose(np.array(row.t).reshape(4, 4)[:3, 3], [-0.02, 0.01, -0.01], atol=1e-3)
