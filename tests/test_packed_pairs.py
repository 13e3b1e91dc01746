import numpy as np

from cairn.operators.loop_closing import register_packed
from cairn.operators.registration import IcpParams, nearest_of_all, register_pairs

CELLS = [float(v) for v in np.eye(4).reshape(-1)]


def test_packed_clouds_register_as_rows_do(spark):
    rng = np.random.default_rng(8)
    world = rng.normal(0, 2, (120, 3))
    normals = rng.normal(0, 1, (120, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    clouds = {}
    for node in range(4):
        own = np.sort(rng.choice(120, 60, replace=False))
        clouds[node] = np.column_stack((own, world[own] + [0.05 * node, 0, 0], normals[own], np.ones(60)))
    near = [(1, 0, 2, 10, CELLS), (1, 0, 3, 11, CELLS), (1, 1, 3, 12, CELLS), (1, 1, 9, 13, CELLS)]
    pairs = spark.createDataFrame(near, "robot_id long, src long, dst long, pair long, start array<double>")
    packed = spark.createDataFrame([(1, n, len(c), c.tobytes()) for n, c in clouds.items()], "robot_id long, node long, n long, points binary")
    names = "pair long, point_id long, x double, y double, z double, nx double, ny double, nz double, p_static double"
    side = lambda k: spark.createDataFrame([(r[3], int(c[0]), *c[1:].tolist()) for r in near[:3] for c in clouds[r[k]]], names)
    want = {r.pair: r for r in register_pairs(side(2), side(1), IcpParams(), pairs.select("pair", "start").where("pair < 13")).collect()}
    for most, block in ((20_000, 32), (20_000, 1), (0, 32)):
        got = {r.pair: r for r in register_packed(pairs, packed, IcpParams(), most, block).collect()}
        assert got.keys() == want.keys() == {10, 11, 12}
        for pair, r in got.items():
            assert r.ok == want[pair].ok and np.isclose(r.overlap, want[pair].overlap) and np.allclose(r.t, want[pair].t)


def test_nearest_of_all_keeps_ties_to_the_smaller_row():
    rng = np.random.default_rng(9)
    a, b = rng.integers(-4, 5, (300, 3)) / 3, rng.integers(-4, 5, (700, 3)) / 3
    gap = ((a[:, None] - b[None]) ** 2).sum(2)
    at, d2 = nearest_of_all(a, b)
    assert np.array_equal(at, gap.argmin(1)) and np.array_equal(d2, gap.min(1))
