"""Loops closed all at once, inertial scans against a plain fold, and maps that are read with dangling edges."""

import numpy as np
import pytest

from cairn.operators import graph, loop_closing, smoothing, solve
from cairn.operators.alignment import align_windows
from cairn.operators.gravity import gravity_by_sums
from cairn.operators.inertial import propagate
from cairn.operators.motion import exp_so3, preintegrate
from cairn.operators.registration import IcpParams
from cairn.operators.solve import gravity_and_bias, linear_alignment
from pyspark.sql import functions as F

EYE = np.eye(4)


def cells(m):
    return np.asarray(m, float).reshape(-1).tolist()


def test_propagation_is_the_fold_of_its_samples(spark):
    rng = np.random.default_rng(5)
    rows, anchors, want = [], [], {}
    for robot, n in ((1, 200), (2, 3), (3, 1)):
        at = np.cumsum(rng.integers(1, 900_000, n)) + 1_700_000_000_000_000
        w, a = rng.normal(0, 1, (n, 3)), rng.normal(0, 2, (n, 3))
        rows += [(robot, i, int(t), *map(float, x), *map(float, y)) for i, (t, x, y) in enumerate(zip(at, w, a))]
        start = 5 if n > 5 else 0
        pose, v = EYE.copy(), np.array([1.0, 2.0, 3.0])
        pose[:3, :3], pose[:3, 3] = exp_so3(np.array([0.1, 0.2, 0.3])), [4, 5, 6]
        anchors.append((robot, int(at[start]), cells(pose), v.tolist()))
        r, p = pose[:3, :3], pose[:3, 3]
        for i in range(start, n):
            want[robot, i] = (r, p, v)
            dt = (at[i + 1] - at[i]) / 1e6 if i + 1 < n else 0.0
            force = r @ a[i] + [0, 0, -9.81]
            r, p, v = r @ exp_so3(w[i] * dt), p + v * dt + 0.5 * force * dt * dt, v + force * dt
    stamp = F.timestamp_micros("us").cast("timestamp_ntz").alias("stamp")
    samples = spark.createDataFrame(rows, "robot_id long, event_id long, us long, wx double, wy double, wz double, ax double, ay double, az double").select("robot_id", "event_id", stamp, "wx", "wy", "wz", "ax", "ay", "az")
    at = spark.createDataFrame(anchors, "robot_id long, us long, pose array<double>, v array<double>").select("robot_id", stamp, "pose", "v")
    for bucket_s in (7, 10_000):
        got = {(r.robot_id, r.event_id): r for r in propagate(samples, at, unit=1e6, bucket_s=bucket_s).collect()}
        assert got.keys() == want.keys()
        for key, (r, p, v) in want.items():
            m = np.array(got[key].pose).reshape(4, 4)
            assert np.allclose(m[:3, :3], r, atol=1e-9)
            assert np.allclose(m[:3, 3], p, rtol=1e-9)
            assert np.allclose(got[key].v, v, rtol=1e-9)
    assert propagate(samples.limit(0), at).count() == 0


def seen(world, normals, pose, reach):
    back = np.linalg.inv(pose)
    local, turned = world @ back[:3, :3].T + back[:3, 3], normals @ back[:3, :3].T
    return [(int(i), *map(float, local[i]), *map(float, turned[i]), 0.9) for i in np.flatnonzero((local**2).sum(1) < reach**2)]


@pytest.fixture(scope="module")
def ring(spark):
    """A drifting path around a ring that ends where it began; its last node sees nothing."""
    rng = np.random.default_rng(7)
    world = rng.uniform([-14, -14, -2], [14, 14, 2], (4000, 3))
    normals = rng.normal(0, 1, (4000, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    true = []
    for i in range(25):
        m = EYE.copy()
        m[:3, :3], m[:3, 3] = exp_so3(np.array([0, 0, i / 3.5 + 1.57])), [8 * np.cos(i / 3.5), 8 * np.sin(i / 3.5), 0]
        true.append(m)
    nodes, edges, at = [], [], true[0]
    for i, m in enumerate(true):
        if i:
            wrong = EYE.copy()
            wrong[:3, :3], wrong[:3, 3] = exp_so3(np.array([0, 0, 0.004])), [0.02, 0.01, 0]
            step = np.linalg.inv(true[i - 1]) @ m @ wrong
            edges.append((1, i - 1, i, cells(step), True))
            at = at @ step
        nodes.append((1, i, cells(at)))
    points = [(1, i, *p) for i, m in enumerate(true[:-1]) for p in seen(world, normals, m, 4.0)]
    make = spark.createDataFrame
    return (true, make(nodes, "robot_id long, node long, pose array<double>"), make(edges, "robot_id long, src long, dst long, pose array<double>, reachable boolean"),
            make(points, "robot_id long, node long, point_id long, x double, y double, z double, nx double, ny double, nz double, p_static double"))


def test_closed_loops_bring_a_path_back(spark, ring):
    true, nodes, edges, points = ring
    closed = loop_closing.close_loops(nodes, edges, points, radius=3.0, most_shift=2.0, p=IcpParams(max_dist=1.0, min_translation=1e-4, min_rotation=1e-5))
    pairs = closed.pairs.collect()
    passed = {(r.src, r.dst): np.array(r.t).reshape(4, 4) for r in pairs if r.passed}
    assert len(passed) > 3
    assert len({(r.src, r.dst) for r in pairs}) == len(pairs)
    assert not any(24 in (r.src, r.dst) for r in pairs if r.passed)  # without points nothing registers
    assert any(24 in (r.src, r.dst) and not r.ok for r in pairs)
    for (a, b), t in passed.items():
        assert np.allclose(t, np.linalg.inv(true[a]) @ true[b], atol=0.02)
    linked = {(r.src, r.dst): r.pose for r in closed.edges.collect()}
    assert all(np.allclose(linked[a, b], cells(t)) and np.allclose(np.array(linked[b, a]).reshape(4, 4) @ t, EYE, atol=1e-9) for (a, b), t in passed.items())
    off = lambda rows: np.mean([np.linalg.norm(np.array(r.pose).reshape(4, 4)[:3, 3] - true[r.node][:3, 3]) for r in rows])
    assert off(closed.nodes.collect()) < 0.6 * off(nodes.collect())


def test_size_decides_the_solver_and_not_the_result(spark, ring):
    true, nodes, edges, _ = ring
    loop = [(1, 0, 22, cells(np.linalg.inv(true[0]) @ true[22]), True)]
    linked = edges.unionByName(spark.createDataFrame(loop, edges.schema)).drop("reachable")
    one, parts = ({r.node: r.pose for r in loop_closing.optimize_by_size(nodes, linked, 3, n).collect()} for n in (1000, 3))
    assert one.keys() == parts.keys()
    assert all(np.allclose(one[n], parts[n], atol=1e-5) for n in one)


def test_gravity_by_sums_is_the_solver_that_has_all_samples(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for robot, n, prior_bias in ((1, 40, [0.05, -0.02, 0.03]), (2, 1, [0, 0, 0]), (3, 60, [0.4, 0.1, -0.3])):
        r = [exp_so3(rng.normal(0, 0.6, 3)) for _ in range(n)]
        acc = np.array([m.T @ exp_so3(np.array([0.2, 0.1, 0])) @ [0, 0, 9.81] + prior_bias + rng.normal(0, 0.05, 3) for m in r])
        acc[::10] += rng.normal(0, 3, (len(acc[::10]), 3))  # outliers
        for m, a in zip(r, acc):
            at = EYE.copy()
            at[:3, :3] = m
            rows.append((robot, cells(at), *map(float, a)))
        want[robot] = gravity_and_bias(acc, r)
    out = gravity_by_sums(spark.createDataFrame(rows, "robot_id long, pose array<double>, ax double, ay double, az double")).collect()
    assert {r.robot_id for r in out} == {1, 2, 3}
    for r in out:
        g, bias = want[r.robot_id]
        assert np.allclose([r.gx, r.gy, r.gz], g, atol=1e-4)
        assert np.allclose([r.bias_x, r.bias_y, r.bias_z], bias, atol=1e-4)
        assert np.isclose(np.linalg.norm([r.gx, r.gy, r.gz]), 9.81)


@pytest.mark.parametrize("scaled", [True, False])
def test_windows_align_as_the_dense_system_does(spark, scaled):
    rng = np.random.default_rng(4)
    g = np.array([0.3, -0.2, -9.8])
    g *= 9.81 / np.linalg.norm(g)
    mount = EYE.copy()
    mount[:3, :3], mount[:3, 3] = exp_so3(np.array([0.1, -0.2, 0.3])), [0.2, 0.1, -0.1]
    rows, dense = [], {}
    for robot, n in ((1, 23), (2, 3)):
        r, v, p, poses, folds = np.eye(3), np.array([1.0, 0.5, 0.0]), np.zeros(3), [], []
        for k in range(n):
            at = EYE.copy()
            at[:3, :3], at[:3, 3] = r, p
            laser = at @ mount
            laser[:3, 3] = laser[:3, 3] / 2 if scaled else laser[:3, 3]
            fold = preintegrate(rng.normal(0, 0.5, (20, 3)), rng.normal(0, 1, (20, 3)) - r.T @ g, np.full(20, 0.02))
            poses.append(laser + np.pad(rng.normal(0, 1e-4, (3, 1)), ((0, 1), (3, 0))))
            rows.append((robot, k, cells(poses[-1]), *((None,) * 3 if not k else (folds[-1].dp.tolist(), folds[-1].dv.tolist(), float(folds[-1].dt)))))
            folds.append(fold)
            p, v, r = p + v * fold.dt + 0.5 * g * fold.dt**2 + r @ fold.dp, v + g * fold.dt + r @ fold.dv, r @ fold.dr
        for w in range((n - 1) // 4 + 1):
            own = slice(4 * w, min(4 * w + 8, n))
            count = own.stop - own.start
            dense[robot, w] = (count, linear_alignment(poses[own], folds[own.start : own.stop - 1], mount, scaled=scaled) if count >= 4 else None)
    out = align_windows(spark.createDataFrame(rows, "robot_id long, frame_id long, pose array<double>, dp array<double>, dv array<double>, dt double"), 8, 4, mount, scaled=scaled).collect()
    assert {(r.robot_id, r.window): r.n for r in out} == {k: v[0] for k, v in dense.items()}
    assert sum(r.ok for r in out) > 3
    for r in out:
        want = dense[r.robot_id, r.window][1]
        assert r.ok == (want is not None)
        if r.ok:
            assert np.allclose([r.gx, r.gy, r.gz], want[1], atol=1e-5)
            assert np.isclose(r.scale, want[2], atol=1e-5)
            assert np.allclose(r.velocities, want[0], atol=1e-4)


def test_the_banded_smoother_is_the_dense_one():
    rng = np.random.default_rng(3)
    g, p, v, r = np.array([0, 0, -9.81]), np.zeros(3), np.array([1.0, 0.5, 0]), np.eye(3)
    states, folds, moves = [], [], []
    for _ in range(6):
        fold = preintegrate(rng.normal(0, 0.3, (10, 3)) + 0.02, rng.normal(0, 1, (10, 3)) - r.T @ g + 0.05, np.full(10, 0.03))
        states.append((p + rng.normal(0, 0.02, 3), v + rng.normal(0, 0.05, 3), r @ exp_so3(rng.normal(0, 0.01, 3))))
        folds.append(fold)
        p, v, r = p + v * fold.dt + 0.5 * g * fold.dt**2 + r @ fold.dp, v + g * fold.dt + r @ fold.dv, r @ fold.dr
    folds.pop()
    at = [np.vstack((np.column_stack((r, p)), [0, 0, 0, 1])) for p, _, r in states]
    moves = [np.linalg.inv(a) @ b for a, b in zip(at, at[1:])]
    want, bias, ok = solve.smooth_window([solve.NavState(*s) for s in states], folds, moves, g)
    got, fine = smoothing.smooth_band(smoothing.Window(*(np.array(x) for x in zip(*states)), np.zeros((6, 6))), folds, np.array(moves), g)
    assert fine == ok
    for i, s in enumerate(want):
        assert np.allclose(s.p, got.p[i], atol=1e-7)
        assert np.allclose(s.v, got.v[i], atol=1e-7)
        assert np.allclose(s.r, got.r[i], atol=1e-7)
    assert np.allclose(bias, got.b[-1], atol=1e-7)


def test_neighbours_that_are_not_in_the_map_are_passed_over(spark):
    step = EYE.copy()
    step[0, 3] = 1.0
    own = lambda x: cells(EYE + np.pad([[x]], ((0, 3), (3, 0))))
    known = spark.createDataFrame([(1, n, own(10.0 * n)) for n in (0, 2, 4, 5, 6)], "robot_id long, node long, pose array<double>")
    back = cells(np.linalg.inv(step))
    edges = spark.createDataFrame([(1, 2, 1, back), (1, 4, 3, back), (1, 4, 0, back), (1, 5, 3, back), (1, 6, 5, back), (1, 0, 2, back)], "robot_id long, src long, dst long, pose array<double>")
    got = {r.node: r.pose[3] for r in graph.pose_by_scan(edges, known).collect()}
    assert got == {0: 0.0, 2: 20.0, 4: 1.0, 5: 50.0, 6: 51.0}
    assert graph.pose_by_scan(edges.limit(0), known).count() == 5
