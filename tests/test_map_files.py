"""Maps through their files: sessions, broken files, closed circles, and streams that are followed."""

import numpy as np

from cairn.operators import graph
from cairn.sources import formats, pointclouds
from cairn.streaming import robots as R

SF = "/root/testdata/sf0.001"


def at(x, y, yaw=0.0):
    c, s = float(np.cos(yaw)), float(np.sin(yaw))
    return [c, -s, 0.0, float(x), s, c, 0.0, float(y), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def node(i, neighbours, mark="<inMap>true</inMap>"):
    rows = "".join(f"<neighbour><id>{j}</id><transform>{t}</transform><reachable>{str(r).lower()}</reachable></neighbour>" for j, t, r in neighbours)
    return f"<node><id>{i}</id>{mark}<neighbour_list>{rows}</neighbour_list></node>"


def write(path, *nodes):
    path.write_text("<map><property><node_count>3</node_count></property><node_list>" + "".join(nodes) + "</node_list></map>")
    return str(path)


def test_nodes_without_the_mark_are_new(spark, tmp_path):
    step, back = "1 0 0 1 0 0 0", "-1 0 0 1 0 0 0"
    path = write(tmp_path / "map.xml", node(0, [(1, step, True)]), node(1, [(0, back, False), (2, step, True)]), node(2, [(1, back, False)], ""), node(5, [], ""))
    known, new, edges = formats.read_sessions(spark, path)
    assert {r.id: r.pose[3] for r in known.collect()} == {0: 0.0, 1: 1.0}
    assert sorted(r.id for r in new.collect()) == [2, 5]
    assert edges.count() == 4


def test_broken_files_give_none(spark, tmp_path):
    good = write(tmp_path / "good.xml", node(0, [(1, "1 0 0 1 0 0 0", True)]))
    (tmp_path / "bad.xml").write_text("<map><node><id>zero</id></node></map>")
    (tmp_path / "empty.xml").write_text("<map></map>")
    assert formats.topology_or_none(spark, good)[1].count() == 1
    assert formats.topology_or_none(spark, str(tmp_path / "bad.xml")) is None
    assert formats.topology_or_none(spark, str(tmp_path / "empty.xml")) is None


def test_a_written_map_is_closed(spark, tmp_path):
    nodes = spark.createDataFrame([(i, at(i, 0)) for i in range(4)], "id long, pose array<double>")
    edges = spark.createDataFrame([(i, i + 1, at(1, 0), False) for i in range(3)], "src long, dst long, pose array<double>, reachable boolean")
    formats.write_closed_map(edges, nodes, str(tmp_path / "map"))
    got = {(r.src, r.dst): (r.pose[3], r.reachable) for r in formats.read_topology(spark, str(tmp_path / "map"))[1].collect()}
    assert got[0, 3] == (3.0, True)
    assert got[3, 0] == (-3.0, True)
    assert all(r for _, r in got.values())


def test_poses_by_reading_order(spark):
    edges = spark.createDataFrame([(1, 3, 1, at(0, 1, 0.5), True), (1, 3, 2, at(9, 9), True), (1, 2, 3, at(1, 1), True)], "robot_id long, src long, dst long, pose array<double>, reachable boolean")
    known = spark.createDataFrame([(1, n, at(n, 0)) for n in (1, 2, 3)], "robot_id long, node long, pose array<double>")
    got = {r.node: np.array(r.pose).reshape(4, 4) for r in graph.pose_by_scan(edges, known).collect()}
    assert np.allclose(got[2], np.array(at(2, 0)).reshape(4, 4))
    assert np.allclose(got[3], np.array(at(1, 0)).reshape(4, 4) @ np.linalg.inv(np.array(at(0, 1, 0.5)).reshape(4, 4)))


def test_a_followed_stream_stops_when_told(spark, tmp_path):
    out = str(tmp_path / "out")
    scans = R.message_stream(spark, SF).where("topic = 'click'").select("event_id")

    def full():
        try:
            return spark.read.schema("event_id long").parquet(out).count() > 0
        except Exception:  # nothing is there yet
            return False

    R.follow(scans, out, full, every="200 milliseconds", limit_s=120)
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'click'").count()


def test_records_that_are_no_points_are_left_out(spark):
    data = np.array([(1, 2, 3, 9), (np.nan, 0, 0, 9)], "<f4").tobytes() + b"\0\0"
    fields = [("y", 4, 7), ("x", 0, 7), ("z", 8, 7), ("other", 12, 7)]
    rows = spark.createDataFrame([(5, fields, 16, bytearray(data)), (6, fields, 16, bytearray(b""))], pointclouds.MESSAGE)
    assert [tuple(r) for r in pointclouds.decode_clouds(rows).collect()] == [(5, 0, 1.0, 2.0, 3.0)]
    assert [r.x for r in pointclouds.decode_clouds(rows, ("x", "y", "z", "r")).select("x").collect()] == [1.0]
    assert [pointclouds.guess_source(*x) for x in ((True, True), (False, True), (False, False))] == ["imu", "odom", "velocity"]


def test_the_other_rule_joins_ends_that_are_not_linked(spark):
    nodes = spark.createDataFrame([(r, i, at(i + 1, 0)) for r in (1, 2) for i in range(4)], "robot_id long, node long, pose array<double>")
    edges = spark.createDataFrame([(1, 0, 2, at(2, 0), False), (2, 0, 3, at(3, 0), False)], "robot_id long, src long, dst long, pose array<double>, reachable boolean")
    got = {(r.robot_id, r.src, r.dst): (r.pose[3], r.reachable) for r in graph.close_circle(edges, nodes, from_origin=True).collect()}
    assert got == {(1, 0, 2): (2.0, False), (1, 0, 3): (4.0, True), (1, 3, 0): (-4.0, True), (2, 0, 3): (3.0, False)}
