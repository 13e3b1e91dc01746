"""Folders by id that tasks write and read by themselves, and the same through Spark's writers and readers."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.sources import formats

FIX = [f.split()[0] for f in formats.GPS_FIELDS.split(", ")]


@pytest.mark.parametrize("plain", [True, False])
def test_folders_come_back_whole(spark, tmp_path, monkeypatch, plain):
    if not plain:
        monkeypatch.setattr(formats, "plain_path", lambda _: None)
    nodes = spark.range(7, 60, 1, 3).select("id", P.from_yaw(F.lit(0.0), F.col("id") * 1.5, F.lit(2.0)).alias("pose"))
    poses, fixes = str(tmp_path / "poses"), str(tmp_path / "fixes")
    formats.write_poses(nodes.where("id > 50"), poses)
    formats.write_poses(nodes, poses, offset=1)  # takes the place of what was there
    assert {r.id: r.pose[3] for r in formats.read_node_poses(spark, poses).collect()} == {k + 1: 1.5 * k for k in range(7, 60)}
    rows = nodes.select("id", *[(F.col("id") + n * 0.25).alias(c) for n, c in enumerate(FIX)], F.when(F.col("id") % 2 == 0, 1).alias("status"), F.lit(6).alias("satellites_used"))
    formats.write_node_gps(rows, fixes)
    got = {r.node: r for r in formats.read_node_gps(spark, fixes).collect()}
    assert sorted(got) == list(range(7, 60))
    assert all(got[k][c] == k + n * 0.25 and got[k].satellites_used == 6 and got[k].status == (1 if k % 2 == 0 else None) for k in got for n, c in enumerate(FIX))


def test_the_driver_lists_no_folders(spark, tmp_path):
    path = str(tmp_path / "poses")
    formats.write_poses(spark.range(20).select("id", P.identity().alias("pose")), path)
    assert len(list((tmp_path / "poses").glob("id=*/*.txt"))) == 20
    assert formats.read_node_poses(spark, path).inputFiles() == []


def test_a_fix_may_be_the_root(spark, tmp_path):
    for name in ("5", "id=6"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "gps.xml").write_text("<?xml version='1.0'?>\n<gps>\n<northing>2.5</northing><status><status>3</status></status></gps>")
    (tmp_path / "_SUCCESS").write_text("")
    assert sorted((r.node, r.northing, r.status, r.altitude) for r in formats.read_node_gps(spark, str(tmp_path)).collect()) == [(5, 2.5, 3, None), (6, 2.5, 3, None)]
