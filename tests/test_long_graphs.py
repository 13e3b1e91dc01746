"""Traversals without a bound on hops, on both paths."""

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import graph

EDGE = "robot_id long, src long, dst long, pose array<double>, reachable boolean"
SEED = "robot_id long, node long, pose array<double>"


def at(x, y, yaw=0.0):
    c, s = np.cos(yaw), np.sin(yaw)
    return [float(v) for v in (c, -s, 0, x, s, c, 0, y, 0, 0, 1, 0, 0, 0, 0, 1)]


def chain(spark, n, robot=1):
    """Both directions between consecutive nodes 0 to n - 1, one apart in x."""
    ahead = spark.range(n - 1).select(F.lit(robot).cast("long").alias("robot_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.array(*map(F.lit, at(1.0, -2.0))).alias("pose"), F.lit(True).alias("reachable"))
    return ahead.unionByName(ahead.select("robot_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.array(*map(F.lit, at(-1.0, 2.0))), F.lit(False)).toDF(*ahead.columns))


def test_a_chain_longer_than_ten_thousand_hops(spark):
    n = 10_500
    seeds = spark.createDataFrame([(1, 0, at(0, 0)), (2, 0, at(5, 0))], SEED)
    got = graph.traverse(chain(spark, n).unionByName(chain(spark, 7, robot=2)), seeds, task_edges=0).collect()
    assert len(got) == n + 7
    assert all((r.hop, r.pose[3], r.pose[7]) == (r.node, r.node + (5.0 if r.robot_id == 2 else 0.0), -2.0 * r.node) and r.parent == (r.node - 1 if r.node else None) for r in got)


def test_large_and_small_traversals_agree(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, i + 1, at(1, g, 0.1), True) for g in (1, 2, 3) for i in range(60)]
    rows += [(g, i + 1, i, at(-1, -g, -0.1), False) for g in (1, 2) for i in range(60)]
    rows += [(g, int(a), int(b), at(b - a, 3, 0.2), True) for g in (1, 3) for a, b in rng.integers(0, 61, (6, 2))] + [(2, 7, 7, at(1, 1), True), (2, 90, 91, at(1, 1), True)]
    edges = spark.createDataFrame(rows, EDGE)
    seeds = spark.createDataFrame([(1, 0, at(0, 0)), (2, 30, at(1, 0)), (3, 20, at(0, 0)), (4, 1, at(2, 2))], SEED)
    for hops in (None, 40):
        small, large = (sorted((r.robot_id, r.node, r.hop, str(r.parent), *np.round(r.pose, 9)) for r in graph.traverse(edges, seeds, hops, task_edges=n).collect()) for n in (1000, 0))
        assert small == large
        assert len(small) > 100


def test_a_shortest_path_of_more_than_a_hundred_hops(spark):
    ends = spark.createDataFrame([(1, 3, 300)], "robot_id long, source long, target long")
    got = sorted((r.step, r.node, r.pose[3]) for r in graph.shortest_path(chain(spark, 400), ends).collect())
    assert got == [(i, i + 3, float(i)) for i in range(298)]
