"""Fixes that are much older than their frame."""

import duckdb

from cairn.operators import temporal


def test_a_fix_of_any_age_is_found(spark):
    at = "cast(timestamp_seconds({}) as timestamp_ntz) stamp"
    frames = spark.range(400).selectExpr("id % 3 as robot_id", "id as frame_id", at.format("1700000000 + id * 40000 + id % 7"))
    sparse = "id < 30 or id % 131 = 5"
    fixes = spark.range(400).where(sparse).selectExpr("id % 2 as robot_id", "id as event_id", at.format("1700000000 + id * 40000 + id % 5"), "cast(id as double) easting", "cast(-id as double) northing")
    got = sorted((r.robot_id, r.frame_id, r.easting, r.northing, r.status) for r in temporal.gps_to_frames(frames, fixes, "robot_id", "hour").collect())
    l, r = frames.toPandas(), fixes.toPandas()
    sql = """SELECT l.robot_id, frame_id, easting, northing, CASE WHEN date_trunc('hour', l.stamp) = date_trunc('hour', r.stamp) THEN 1 ELSE 0 END
      FROM l ASOF LEFT JOIN r ON l.robot_id = r.robot_id AND l.stamp >= r.stamp"""
    expected = sorted(duckdb.sql(sql).fetchall())
    assert str(got) == str(expected)
    age = duckdb.sql("SELECT max(l.stamp - r.stamp) > INTERVAL 35 DAY FROM l ASOF JOIN r ON l.robot_id = r.robot_id AND l.stamp >= r.stamp").fetchall()[0][0]
    assert age
