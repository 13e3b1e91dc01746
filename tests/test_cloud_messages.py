"""Clouds of more than one message."""

from cairn.sources import pointclouds


def test_records_are_numbered_through_all_messages_of_a_cloud(spark):
    rows = [(c, i, i + 0.5, float(c), 0.0) for c in (1, 2) for i in range(c, 40, 3)]
    points = spark.createDataFrame(rows, "cloud_id long, point_id long, x double, y double, z double")
    out = pointclouds.decode_clouds(pointclouds.encode_clouds(points, most=10)).collect()
    for c in (1, 2):
        assert [(r.nth, r.x) for r in sorted(out, key=lambda r: r.nth) if r.cloud_id == c] == [(n, r[2]) for n, r in enumerate(r for r in rows if r[0] == c)]
