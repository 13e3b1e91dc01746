from pathlib import Path

from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.sources import formats


def test_folders_of_a_small_table_are_made_by_many_tasks(spark, tmp_path):
    nodes = spark.range(0, 60, 1, 1).select("id", P.from_yaw(F.lit(0.1), F.col("id").cast("double"), F.lit(2.0)).alias("pose"))
    formats.write_poses(nodes, str(tmp_path / "out"), offset=1)
    files = [f.name for f in Path(tmp_path / "out").rglob("part-*")]
    assert len(files) == 60
    assert len({f.split("-")[1] for f in files}) > 1
    got = formats.read_node_poses(spark, str(tmp_path / "out")).collect()
    assert {r.id: r.pose[3] for r in got} == {i + 1: float(i) for i in range(60)}
