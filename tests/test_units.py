"""Closed-form and planted answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import extrinsics
from cairn.functions import pose as P
from cairn.operators import clouds, graph, motion, registration, solve, temporal
from cairn.sources import formats


def pose(yaw=0.0, t=(0.0, 0.0, 0.0)):
    out = np.eye(4)
    out[:3, :3] = motion.exp_so3(np.array([0, 0, yaw]))
    out[:3, 3] = t
    return out


def test_pose_algebra(spark):
    rows = spark.range(40).select(*[((F.col("id") * k) % 7 - 3.3).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))])
    t = rows.select("a", "b", "c", P.so3_exp(F.col("a"), F.col("b"), F.col("c")).alias("r"))
    again = P.let(P.to_quaternion(F.col("r")), lambda q: P.from_quaternion(q["w"], q["x"], q["y"], q["z"]))
    unit = P.product(F.col("r"), P.inverse(F.col("r")))
    log = P.so3_log(F.col("r"))
    for r in t.select("r", again.alias("again"), unit.alias("unit"), P.rotation_angle(F.col("r")).alias("angle"), log.alias("log"), P.unpack(P.pack(F.col("r"))).alias("text")).collect():
        assert np.allclose(r.again, r.r, atol=1e-9)
        assert np.allclose(r.unit, np.eye(4).reshape(-1), atol=1e-9)
        assert np.allclose(r.text, r.r, atol=1e-9)
        assert abs(r.angle - np.linalg.norm(r.log)) < 1e-6
    small = spark.range(1).select(P.so3_exp(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("r"), P.wrap_angle(F.lit(4.0)).alias("w"), P.from_roll_pitch_yaw(F.lit(0.0), F.lit(0.0), F.lit(0.3)).alias("y")).first()
    assert np.allclose(small.r, np.eye(4).reshape(-1))
    assert abs(small.w - (4.0 - 2 * 3.1416)) < 1e-9
    assert np.allclose(small.y, pose(0.3).reshape(-1))


def test_exp_log_in_numpy():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.normal(0, 1, 3)
        v *= min(1, 3.1 / np.linalg.norm(v))
        assert np.allclose(motion.log_so3(motion.exp_so3(v)), v, atol=1e-6)
    half_turn = np.pi * np.array([0.6, 0.0, 0.8])
    assert np.allclose(motion.exp_so3(motion.log_so3(motion.exp_so3(half_turn))), motion.exp_so3(half_turn), atol=1e-6)


def test_constant_motion_has_its_closed_form():
    n, dt, a, w = 1000, 0.001, 2.0, 0.5
    m = motion.preintegrate(np.tile([0, 0, 0.0], (n, 1)), np.tile([a, 0, 0.0], (n, 1)), np.full(n, dt))
    assert np.allclose(m.dp, [a / 2, 0, 0])
    assert np.allclose(m.dv, [a, 0, 0])
    assert abs(m.dt - 1) < 1e-9
    turned = motion.preintegrate(np.tile([0, 0, w], (n, 1)), np.zeros((n, 3)), np.full(n, dt))
    assert np.allclose(turned.dr, motion.exp_so3(np.array([0, 0, w])))
    assert (np.linalg.eigvalsh(m.cov) > -1e-12).all()


def test_bias_derivatives():
    rng = np.random.default_rng(2)
    w, a, dt = rng.normal(0, 0.3, (20, 3)), rng.normal(0, 1, (20, 3)), np.full(20, 0.05)
    m, h = motion.preintegrate(w, a, dt), 1e-5
    for i in range(3):
        d = np.zeros(3)
        d[i] = h
        up, down = motion.preintegrate(w, a - d, dt), motion.preintegrate(w, a + d, dt)
        assert np.allclose((up.dp - down.dp) / (2 * h), m.p_ba[:, i], atol=1e-4)
        up, down = motion.preintegrate(w - d, a, dt), motion.preintegrate(w + d, a, dt)
        assert np.allclose((up.dv - down.dv) / (2 * h), m.v_bg[:, i], atol=1e-2)
        assert np.allclose(motion.log_so3(m.dr.T @ up.dr) / h, m.r_bg[:, i], atol=1e-3)


def cube(n=400, seed=3):
    rng = np.random.default_rng(seed)
    face, uv = rng.integers(0, 3, n), rng.random((n, 2))
    xyz, normal = np.zeros((n, 3)), np.zeros((n, 3))
    for i in range(n):
        axes = [a for a in range(3) if a != face[i]]
        xyz[i, axes] = uv[i]
        normal[i, face[i]] = -1
    return xyz, normal


def test_icp_recovers_a_planted_transform(spark):
    xyz, normal = cube()
    planted = pose(0.05, (0.04, -0.03, 0.02))
    back = np.linalg.inv(planted)
    moved, turned = xyz @ back[:3, :3].T + back[:3, 3], normal @ back[:3, :3].T
    t, overlap = registration.icp(moved, turned, xyz, normal, np.ones(len(xyz)))
    assert np.allclose(t, planted, atol=2e-3)
    assert overlap > 0.5
    with pytest.raises(registration.ConvergenceError):
        registration.icp(moved + 1000, turned, xyz, normal, np.ones(len(xyz)))
    schema = "point_id long, x double, y double, z double, nx double, ny double, nz double, p_static double"
    frame = lambda p, n: spark.createDataFrame([(i, *map(float, p[i]), *map(float, n[i]), 1.0) for i in range(len(p))], schema)
    t, _ = registration.register(frame(moved, turned), frame(xyz, normal), p=registration.IcpParams(max_dist=0.5, max_iterations=4))
    assert np.allclose(t, planted, atol=2e-2)


def test_pose_graph_undoes_drift():
    side = [pose(np.pi / 2 * (i // 10), (i % 10, i // 10, 0)) for i in range(40)]
    edges = [(i, i + 1, np.linalg.inv(side[i]) @ side[i + 1]) for i in range(39)] + [(39, 0, np.linalg.inv(side[39]) @ side[0])]
    drifted = [side[0]] + [p @ pose(0.01 * i, (0.02 * i, -0.01 * i, 0)) for i, p in enumerate(side[1:], 1)]
    out, before, after = solve.optimize_poses(drifted, edges)
    assert before > 1e-3 > 1e-8 > after
    assert np.allclose(out[0], side[0])
    assert np.allclose(out[39], side[39], atol=1e-3)


def test_gravity_and_bias():
    rng = np.random.default_rng(5)
    r = [motion.exp_so3(rng.normal(0, 0.5, 3)) for _ in range(30)]
    bias, g = np.array([0.1, -0.05, 0.02]), np.array([0.3, -0.2, -9.8])
    g *= 9.81 / np.linalg.norm(g)
    acc = np.array([m.T @ -g + bias for m in r])
    found, found_bias = solve.gravity_and_bias(acc, r, prior=1e-6)
    assert np.allclose(found, g, atol=1e-3)
    assert np.allclose(found_bias, bias, atol=1e-3)


def test_smoother_keeps_a_consistent_window():
    n, dt = 20, 0.05
    m = motion.preintegrate(np.zeros((n, 3)), np.tile([0.5, 0, 0], (n, 1)), np.full(n, dt))
    p, v, states = np.zeros(3), np.array([1.0, 0, 0]), []
    for _ in range(4):
        states.append(solve.NavState(p, v, np.eye(3)))
        p, v = p + v * m.dt + m.dp, v + m.dv
    moves = [pose(t=tuple(b.p - a.p)) for a, b in zip(states, states[1:])]
    off = [states[0], *[solve.NavState(s.p + 0.1, s.v, s.r) for s in states[1:]]]
    out, bias, ok = solve.smooth_window(off, [m] * 3, moves, np.zeros(3))
    assert ok
    assert np.allclose(bias, 0, atol=1e-2)
    assert np.allclose(out[-1].p, states[-1].p, atol=1e-2)


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 10, "2024-01-01 00:00:10"), (1, 11, "2024-01-01 00:01:00")], "robot_id long, frame_id long, s string").selectExpr("robot_id", "frame_id", "cast(s as timestamp_ntz) stamp")
    right = spark.createDataFrame([(1, 1, "2024-01-01 00:00:10"), (1, 2, "2024-01-01 00:00:10"), (1, 3, "2024-01-01 00:00:11"), (2, 4, "2024-01-01 00:00:59")], "robot_id long, event_id long, s string").selectExpr("robot_id", "event_id", "cast(s as timestamp_ntz) stamp")
    got = lambda f, tol: {r.frame_id: r.m for r in f(left, right, "robot_id", tol, {"m": "event_id"}).collect()}
    assert got(temporal.asof_backward, 1.0) == {10: 2, 11: None}
    assert got(temporal.asof_backward, 49.0) == {10: 2, 11: 3}
    assert got(temporal.asof_forward, 1.0)[11] is None
    assert got(temporal.asof_nearest, 60.0)[11] == 3


def test_both_traversals_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(a), int(b), pose(yaw=0.3 * a - 0.2 * b, t=(float(a - b), float(a * b % 5), 0.0)).reshape(-1).tolist(), True) for g in (1, 2) for a, b in rng.integers(0, 30, (60, 2)) if a != b]
    edges = spark.createDataFrame(rows, "robot_id long, src long, dst long, pose array<double>, reachable boolean")
    seeds = spark.createDataFrame([(g, n, pose(t=(x, 0.0, 0.0)).reshape(-1).tolist()) for g, n, x in ((1, 0, 0.0), (2, 3, 1.0), (3, 9, 0.0))], "robot_id long, node long, pose array<double>")
    for hops in (None, 2):
        whole, loop = (sorted((r.robot_id, r.node, r.hop, str(r.parent), *np.round(r.pose, 9)) for r in graph.traverse(edges, seeds, hops, task_edges=n).collect()) for n in (1000, 0))
        assert whole == loop
        assert len(whole) >= 5


def test_missing_fixed_node_raises(spark):
    nodes = spark.createDataFrame([(1, 5)], "robot_id long, node long")
    edges = spark.createDataFrame([], "robot_id long, src long, dst long, pose array<double>, reachable boolean")
    with pytest.raises(ValueError, match="fixed node"):
        graph.link_nodes(edges, nodes)


def test_spherical_at_the_origin(spark):
    r = clouds.spherical(spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")).first()
    assert (r.r, r.inclination, r.azimuth) == (0.0, 0.0, 0.0)


def test_chain_text():
    assert formats.parse_chain("- A:\n    n: 5\n    name: x\n# no\n- B\n") == [("A", {"n": 5.0, "name": "x"}), ("B", {})]
    with pytest.raises(ValueError, match="filter chain"):
        formats.parse_chain("nonsense")
    with pytest.raises(ValueError, match="unknown filter"):
        clouds.apply_chain(None, [("NoSuchFilter", {})])


def test_topology_with_one_and_no_neighbour(spark, tmp_path):
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    edges = spark.createDataFrame([(0, 1, False)], "src long, dst long, reachable boolean").withColumn("pose", P.from_yaw(F.lit(0.2), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    formats.write_topology(edges, nodes, str(tmp_path / "map"))
    back_nodes, back = formats.read_topology(spark, str(tmp_path / "map"))
    assert sorted(r.id for r in back_nodes.collect()) == [0, 1, 2]
    row = back.collect()
    assert [(r.src, r.dst, r.reachable) for r in row] == [(0, 1, False)]
    assert np.allclose(row[0].pose, pose(0.2, (1, 2, 3)).reshape(-1), atol=1e-9)
    assert formats.read_topology(spark, str(tmp_path / "map"), force_reachable=True)[1].first().reachable


def test_pose_text(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("1 0 0 -40\n0 1 0 5\n0 0 1 0\n")
    assert formats.read_pose(spark, str(tmp_path / "p")).first().pose == [1, 0, 0, -40, 0, 1, 0, 5, 0, 0, 1, 0, 0, 0, 0, 1]
    nodes = spark.createDataFrame([(7,)], "id long").withColumn("pose", P.from_yaw(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    formats.write_poses(nodes, str(tmp_path / "out"))
    assert formats.read_pose(spark, str(tmp_path / "out/id=7")).first().pose[3] == 1.0


def test_frames_file(spark, tmp_path):
    gps = F.struct(*[F.lit(1.0).alias(n) for n in "timestamp northing easting altitude latitude longitude roll pitch yaw".split()], F.lit(5).alias("satellites_used"), F.lit(1).alias("status"))
    rows = spark.createDataFrame([(0, 3, 4, 1.5), (0, 3, 5, 2.5)], "keyframe_id long, keyframe_frame_id long, id long, time double").withColumns({"pose": P.identity(), "gps": gps})
    formats.write_frames(rows, str(tmp_path / "f"))
    back = formats.read_frames(spark, str(tmp_path / "f")).collect()
    assert sorted((r.keyframe_id, r.id, r.time, r.gps.satellites_used) for r in back) == [(0, 4, 1.5, 5), (0, 5, 2.5, 5)]


def test_jacobians_of_rotations():
    rng = np.random.default_rng(3)
    for _ in range(10):
        v, h = rng.normal(0, 1, 3), 1e-6
        right = np.column_stack([motion.log_so3(motion.exp_so3(v).T @ motion.exp_so3(v + h * e)) / h for e in np.eye(3)])
        left = np.column_stack([motion.log_so3(motion.exp_so3(v + h * e) @ motion.exp_so3(v).T) / h for e in np.eye(3)])
        assert np.allclose(motion.right_jacobian(v), right, atol=1e-5)
        assert np.allclose(motion.left_jacobian(v), left, atol=1e-5)
        assert np.allclose(motion.inverse_right_jacobian(v) @ motion.right_jacobian(v), np.eye(3), atol=1e-9)
        assert np.allclose(motion.exps_so3(v[None])[1][0], motion.right_jacobian(v), atol=1e-9)


def test_preintegration_derivatives_and_covariance():
    rng = np.random.default_rng(6)
    gyro, acc, dts = rng.normal(0, 0.5, (12, 3)), rng.normal(0, 2, (12, 3)), rng.uniform(0.01, 0.1, 12)
    m, h = motion.preintegrate(gyro, acc, dts), 1e-6
    for k, e in enumerate(np.eye(3)):
        by_gyro, by_acc = motion.preintegrate(gyro - h * e, acc, dts), motion.preintegrate(gyro, acc - h * e, dts)
        assert np.allclose((by_gyro.dp - m.dp) / h, m.p_bg[:, k], atol=1e-4)
        assert np.allclose((by_gyro.dv - m.dv) / h, m.v_bg[:, k], atol=1e-4)
        assert np.allclose((by_acc.dp - m.dp) / h, m.p_ba[:, k], atol=1e-4)
        assert np.allclose((by_acc.dv - m.dv) / h, m.v_ba[:, k], atol=1e-4)
        assert np.allclose(motion.log_so3(m.dr.T @ by_gyro.dr) / h, m.r_bg[:, k], atol=1e-4)
    draws = []
    for _ in range(4000):
        n = motion.preintegrate(gyro + rng.normal(0, 0.01, gyro.shape), acc + rng.normal(0, 0.1, acc.shape), dts)
        draws.append(np.concatenate((n.dp - m.dp, n.dv - m.dv, motion.log_so3(m.dr.T @ n.dr))))
    assert np.allclose(np.cov(np.array(draws).T), m.cov, atol=0.1 * np.abs(m.cov).max())


def test_default_mounting():
    there, back = extrinsics.body_laser()
    assert np.allclose(there @ back, np.eye(4), atol=1e-9)
    rows = np.array(extrinsics.CAMERA_OF_LASER)[:3]
    given, _ = extrinsics.body_laser(np.eye(4)[:3], rows, np.array(extrinsics.BODY_CAMERA))
    assert np.allclose(given, there)


def dense_box(rng, n=700):
    """Points on three faces of a box, with their normals."""
    face, uv = rng.integers(0, 3, n), rng.uniform(0, 4, (n, 2))
    xyz = np.zeros((n, 3))
    for k in range(3):
        xyz[np.ix_(face == k, [i for i in range(3) if i != k])] = uv[face == k]
    return xyz, np.eye(3)[face]


def cloud_frame(spark, xyz, normals, pair=0):
    rows = [(pair, i, *map(float, p), *map(float, n), 1.0) for i, (p, n) in enumerate(zip(xyz, normals))]
    return spark.createDataFrame(rows, "pair long, point_id long, x double, y double, z double, nx double, ny double, nz double, p_static double")


def test_large_and_small_registrations_agree(spark):
    rng = np.random.default_rng(11)
    xyz, n = dense_box(rng)
    there = pose(0.04, (0.1, -0.06, 0.05))
    moved, turned = xyz @ there[:3, :3].T + there[:3, 3], n @ there[:3, :3].T
    reading = cloud_frame(spark, moved, turned).unionByName(cloud_frame(spark, moved + 500, turned, 1)).unionByName(cloud_frame(spark, moved[:5], turned[:5], 2))
    reference = cloud_frame(spark, xyz, n).unionByName(cloud_frame(spark, xyz, n, 1))
    p = registration.IcpParams(knn=3, max_dist=1.0, max_iterations=12)
    for limit in (10**9, 0):
        out = {r.pair: r for r in registration.register_pairs(reading, reference, p, task_distances=limit).collect()}
        assert np.allclose(np.array(out[0].t).reshape(4, 4) @ there, np.eye(4), atol=5e-3)
        assert out[0].ok and out[0].overlap > 0.7
        assert not out[1].ok and not out[2].ok
        assert [r.pair for r in registration.overlap_gate(registration.register_pairs(reading, reference, p, task_distances=limit)).collect()] == [0]


def test_bootstrap_needs_scans_in_a_row(spark):
    rng = np.random.default_rng(12)
    xyz, n = dense_box(rng, 200)
    good, bad = cloud_frame(spark, xyz + 0.05, n), cloud_frame(spark, xyz + 900, n)
    p = registration.IcpParams(max_dist=1.0, max_iterations=3)
    assert registration.bootstrap([good, bad, good], cloud_frame(spark, xyz, n), p, rounds=2) is None
    assert np.allclose(registration.bootstrap([bad, good, good], cloud_frame(spark, xyz, n), p, rounds=2)[:3, 3], -0.05, atol=0.02)


def test_chain_files():
    text = "readingDataPointsFilters:\n  - MaxDensityDataPointsFilter:\n      maxDensity: 30\n#9000\nmatcher:\n  KDTreeMatcher:\n    knn: 3\n    maxDist: 2\noutlierFilters:\n  - TrimmedDistOutlierFilter:\n     ratio: 0.75\nerrorMinimizer:\n  PointToPlaneErrorMinimizer\ntransformationCheckers:\n  - CounterTransformationChecker:\n      maxIterationCount: 40\n  - BoundTransformationChecker:\n      maxRotationNorm: 0.80\nlogger:\n#  FileLogger\n  NullLogger\n"
    p = registration.configured(formats.parse_sections(text))
    assert (p.knn, p.max_dist, p.ratio, p.max_iterations, p.max_rotation_norm) == (3, 2.0, 0.75, 40, 0.8)
    assert p.reading_filters == (("MaxDensityDataPointsFilter", {"maxDensity": 30.0}),)
    assert (p.max_angle, p.min_static) == (4.0, -1.0)
    with pytest.raises(ValueError, match="unknown part"):
        registration.configured({"matcher": [("OtherMatcher", {})]})


def test_linear_alignment_finds_gravity_and_scale():
    rng = np.random.default_rng(2)
    g, p, v, r = np.array([0.3, -0.2, -9.8]), np.zeros(3), np.array([1.0, 0.5, 0.0]), np.eye(3)
    g *= 9.81 / np.linalg.norm(g)
    poses, folds, speeds = [pose(t=p)], [], [v]
    for _ in range(8):
        m = motion.preintegrate(rng.normal(0, 0.5, (20, 3)), rng.normal(0, 1, (20, 3)) - r.T @ g, np.full(20, 0.02))
        p, v, r = p + v * m.dt + 0.5 * g * m.dt**2 + r @ m.dp, v + g * m.dt + r @ m.dv, r @ m.dr
        at = np.eye(4)
        at[:3, :3], at[:3, 3] = r, p
        poses.append(at)
        folds.append(m)
        speeds.append(r.T @ v)
    for t in poses:
        t[:3, 3] /= 2
    found, gravity, scale = solve.linear_alignment(poses, folds)
    assert np.allclose(gravity, g, atol=1e-6)
    assert abs(scale - 2) < 1e-6
    assert np.allclose(found[3], speeds[3], atol=1e-6)
    assert solve.linear_alignment(poses, folds, g=20.0) is None


def test_loop_edges_pull_a_drifted_square_together(spark):
    turn, nodes, drifted = pose(np.pi / 2, (1.0, 0.0, 0.0)), [np.eye(4)], [np.eye(4)]
    for i in range(39):
        step = turn if i % 10 == 9 else pose(0.0, (1.0, 0.0, 0.0))
        nodes.append(nodes[-1] @ step)
        drifted.append(drifted[-1] @ step @ pose(0.01, (0.02, 0.01, 0.0)))
    edges = [(i, i + 1, np.linalg.inv(nodes[i]) @ nodes[i + 1]) for i in range(39)] + [(39, 0, np.linalg.inv(nodes[39]) @ nodes[0])]
    out, before, after = solve.optimize_poses(drifted, edges)
    assert before > 1e-3 and after < 1e-9
    assert np.allclose(out, nodes, atol=1e-3)
