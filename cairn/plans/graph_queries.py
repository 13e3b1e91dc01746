"""Queries on the pose graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.operators import graph as G
from cairn.operators.neighbours import loop_candidates

from .views import PLANAR_SQL, edges, keyframes, nodes, planar, planar_product, planar_relative, scan_frames, with_views


def _loops(spark, d):
    """Loop closures: the nearest candidate of each keyframe."""
    best = loop_candidates(keyframes(spark, d), 3.0).groupBy("robot_id", "kf_id").agg(F.min(F.struct("d2", "cand_id")).alias("b")).where("b.d2 < 4")
    return best.select("robot_id", F.col("b.cand_id").alias("src"), F.col("kf_id").alias("dst"))


def _edge_columns(df, group="robot_id"):
    return df.select(group, "src", "dst", *planar(), "reachable")


def chain_edges(spark, d):
    return _edge_columns(edges(spark, d))


def bfs_poses(spark, d):
    """Poses relative to the fixed node, composed along the chain."""
    return G.link_nodes(edges(spark, d), nodes(spark, d)).select("robot_id", "node", "hop", *planar())


def scan_poses(spark, d):
    """Poses from the first neighbour that was read before; the first node keeps its own."""
    e = G.insert_absent(edges(spark, d), G.both_ways(_loops(spark, d), nodes(spark, d)))
    return G.pose_by_scan(e, nodes(spark, d)).select("robot_id", "node", *planar())


def bfs_with_loops(spark, d):
    """Hops from the fixed node when loop closures shorten the way."""
    e = G.insert_absent(edges(spark, d), G.both_ways(_loops(spark, d), nodes(spark, d)))
    return G.link_nodes(e, nodes(spark, d)).select("robot_id", "node", "hop", *planar())


def hop_neighbours(spark, d):
    centres = nodes(spark, d).where("node = 3").select("robot_id", "node")
    return G.neighbour_search(edges(spark, d), centres, 2).select("robot_id", "node", "hop", *planar())


def shortest_path(spark, d):
    ends = nodes(spark, d).groupBy("robot_id").agg(F.max("node").alias("target")).where("target >= 4").select("robot_id", F.lit(0).cast("long").alias("source"), F.lit(4).cast("long").alias("target"))
    return G.shortest_path(edges(spark, d), ends, 6).select("robot_id", "step", "node", *planar())


def edge_insert_absent(spark, d):
    return _edge_columns(G.insert_absent(edges(spark, d), G.both_ways(_loops(spark, d), nodes(spark, d))))


def _shaken(df):
    """Nodes moved and turned by their ids."""
    p = F.col("pose")
    return df.withColumn("pose", P.product(p, P.from_yaw(F.col("node") * 0.1, F.col("node") * 0.5, F.lit(-0.25))))


def edge_upsert(spark, d):
    again = edges(spark, d).where("src % 2 = 0 and dst = src + 1").select("robot_id", "src", "dst")
    return _edge_columns(G.upsert(edges(spark, d), G.both_ways(again, _shaken(nodes(spark, d)))))


def edge_refresh(spark, d):
    return _edge_columns(G.refresh(edges(spark, d), _shaken(nodes(spark, d))))


def reachable_edges(spark, d):
    return _edge_columns(G.optimizable(edges(spark, d), nodes(spark, d).where("node % 5 <> 4")))


def circle_close(spark, d):
    return _edge_columns(G.close_circle(edges(spark, d), nodes(spark, d)))


def _bridge():
    return P.from_yaw(F.lit(0.3), F.lit(1.5), F.lit(-0.5))


def merge_sessions(spark, d):
    """Robots 2k and 2k + 1 as two sessions of one map."""
    e, n = edges(spark, d), nodes(spark, d).groupBy("robot_id").agg(F.count("*").alias("n"))
    group = F.floor(F.col("robot_id") / 2).alias("group")
    side = lambda k: e.where(F.col("robot_id") % 2 == k).select(group, "src", "dst", "pose", "reachable")
    by = n.groupBy(group).agg(*[F.coalesce(F.sum(F.when(F.col("robot_id") % 2 == k, F.col("n"))), F.lit(0)).alias(c) for k, c in ((0, "n_first"), (1, "n_second"))])
    return _edge_columns(G.merge_sessions(side(0), side(1), by, _bridge()), "group")


def session_reposed(spark, d):
    """The second session's nodes, where the bridge puts their origin."""
    return G.repose(nodes(spark, d).where("robot_id % 2 = 1"), _bridge()).select("robot_id", "node", *planar())


def trajectory_export(spark, d):
    places = nodes(spark, d).where("node % 4 = 0")
    frames = scan_frames(spark, d).select("robot_id", "frame_id", (F.col("frame_id") - 1 - (F.col("frame_id") - 1) % 4).alias("kf_id"), P.from_yaw(F.col("frame_id") * 0.01, F.col("x"), F.col("y")).alias("pose"))
    return G.trajectory(places, frames).select("robot_id", "kf_id", "frame_id", *planar())


def pose_correction(spark, d):
    frames = scan_frames(spark, d).select("robot_id", "frame_id", P.from_yaw(F.col("frame_id") * 0.01, F.col("x"), F.col("y")).alias("pose"))
    return G.correct_current(nodes(spark, d), _shaken(nodes(spark, d)), frames).select("robot_id", "frame_id", *planar())


def node_degree(spark, d):
    return G.degree(edges(spark, d))


QUERIES = {f.__name__: f for f in (chain_edges, bfs_poses, scan_poses, bfs_with_loops, hop_neighbours, shortest_path, edge_insert_absent, edge_upsert, edge_refresh, reachable_edges, circle_close, merge_sessions, session_reposed, trajectory_export, pose_correction, node_degree)}

_E = f"{PLANAR_SQL}, reachable"


_LOOPS = f""", loops AS (
  SELECT robot_id, b[2] AS src, kf_id AS dst FROM (
    SELECT a.robot_id, a.kf_id, min(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.kf_id)) AS b
    FROM keyframes a JOIN keyframes b ON a.robot_id = b.robot_id AND b.kf_id + 5 <= a.kf_id AND b.kf_id >= 1
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 GROUP BY ALL) WHERE b[1] < 4
), loop_edges AS (
  SELECT l.robot_id, l.src, l.dst, {planar_relative("a", "b")}, true AS reachable
  FROM (FROM loops UNION ALL SELECT robot_id, dst, src FROM loops) l JOIN keyframes a ON a.robot_id = l.robot_id AND a.kf_id = l.src JOIN keyframes b ON b.robot_id = l.robot_id AND b.kf_id = l.dst
), all_edges AS (
  FROM edges UNION ALL FROM loop_edges
)
"""
_SHAKEN = f""", step AS (
  SELECT robot_id, kf_id, kf_id * 0.5::DOUBLE AS x, -0.25::DOUBLE AS y, kf_id * 0.1::DOUBLE AS yaw FROM keyframes
), shaken AS (
  SELECT k.robot_id, k.kf_id, {planar_product("k", "t")} FROM keyframes k JOIN step t USING (robot_id, kf_id)
)
"""
_BY_ENDS = "JOIN {0} a ON a.robot_id = e.robot_id AND a.kf_id = e.src JOIN {0} b ON b.robot_id = e.robot_id AND b.kf_id = e.dst"
SQL = {
    "chain_edges": with_views(f"SELECT robot_id, src, dst, {_E} FROM edges"),
    "bfs_poses": with_views(f""", seen AS (SELECT k.robot_id, k.kf_id AS node, CAST(k.kf_id AS INTEGER) AS hop, {planar_relative("f", "k")} FROM keyframes k JOIN keyframes f ON f.robot_id = k.robot_id AND f.kf_id = 0)
SELECT robot_id, node, hop, {PLANAR_SQL} FROM seen"""),
    "scan_poses": with_views(f"SELECT robot_id, kf_id AS node, {PLANAR_SQL} FROM keyframes"),
    "bfs_with_loops": with_views(_LOOPS + f""", walk AS (
  SELECT robot_id, 0::BIGINT AS node, 0 AS hop FROM keyframes WHERE kf_id = 0
  UNION SELECT w.robot_id, e.dst, w.hop + 1 FROM walk w JOIN all_edges e ON e.robot_id = w.robot_id AND e.src = w.node WHERE w.hop < 60
), hops AS (
  SELECT robot_id, node, min(hop) AS hop FROM walk GROUP BY ALL
), seen AS (
  SELECT h.robot_id, h.node, h.hop, {planar_relative("f", "k")} FROM hops h JOIN keyframes k ON k.robot_id = h.robot_id AND k.kf_id = h.node JOIN keyframes f ON f.robot_id = h.robot_id AND f.kf_id = 0)
SELECT robot_id, node, hop, {PLANAR_SQL} FROM seen""", recursive=True),
    "hop_neighbours": with_views(f""", seen AS (SELECT c.robot_id, k.kf_id AS node, CAST(abs(k.kf_id - 3) AS INTEGER) AS hop, {planar_relative("c", "k")}
  FROM keyframes c JOIN keyframes k ON c.robot_id = k.robot_id AND c.kf_id = 3 AND abs(k.kf_id - 3) <= 2)
SELECT robot_id, node, hop, {PLANAR_SQL} FROM seen"""),
    "shortest_path": with_views(f""", seen AS (SELECT k.robot_id, CAST(k.kf_id AS INTEGER) AS step, k.kf_id AS node, {planar_relative("c", "k")}
  FROM keyframes k JOIN keyframes c ON c.robot_id = k.robot_id AND c.kf_id = 0 WHERE k.kf_id <= 4 AND k.robot_id IN (SELECT robot_id FROM keyframes WHERE kf_id = 4))
SELECT robot_id, step, node, {PLANAR_SQL} FROM seen"""),
    "edge_insert_absent": with_views(_LOOPS + f"SELECT robot_id, src, dst, {_E} FROM all_edges"),
    "edge_upsert": with_views(_SHAKEN + f""", fresh AS (SELECT e.robot_id, e.src, e.dst, {planar_relative("a", "b")}, true AS reachable FROM edges e {_BY_ENDS.format("shaken")} WHERE least(e.src, e.dst) % 2 = 0), every AS (
  FROM fresh UNION ALL FROM edges WHERE least(src, dst) % 2 <> 0)
SELECT robot_id, src, dst, {_E} FROM every"""),
    "edge_refresh": with_views(_SHAKEN + f", fresh AS (SELECT e.robot_id, e.src, e.dst, {planar_relative('a', 'b')}, e.reachable FROM edges e {_BY_ENDS.format('shaken')}) SELECT robot_id, src, dst, {_E} FROM fresh"),
    "reachable_edges": with_views(f"SELECT robot_id, src, dst, {_E} FROM edges WHERE reachable AND src % 5 <> 4 AND dst % 5 <> 4"),
    "circle_close": with_views(f""", span AS (SELECT robot_id, max(kf_id) AS last FROM keyframes GROUP BY 1 HAVING max(kf_id) > 1), closed AS (
  FROM edges UNION ALL
  SELECT t.robot_id, a.kf_id, b.kf_id, {planar_relative("a", "b")}, true FROM span t JOIN keyframes a ON a.robot_id = t.robot_id JOIN keyframes b ON b.robot_id = t.robot_id
  WHERE (a.kf_id = 0 AND b.kf_id = last) OR (a.kf_id = last AND b.kf_id = 0))
SELECT robot_id, src, dst, {_E} FROM closed"""),
    "merge_sessions": with_views(f""", n AS (SELECT robot_id, count(*) AS n FROM keyframes GROUP BY 1), g AS (
  SELECT robot_id // 2 AS "group", coalesce(sum(n) FILTER (robot_id % 2 = 0), 0)::BIGINT AS a, coalesce(sum(n) FILTER (robot_id % 2 = 1), 0)::BIGINT AS b FROM n GROUP BY 1
), merged AS (
  SELECT "group", src + CASE WHEN robot_id % 2 = 1 THEN a ELSE 0 END AS src, dst + CASE WHEN robot_id % 2 = 1 THEN a ELSE 0 END AS dst, x, y, yaw, reachable FROM edges JOIN g ON robot_id // 2 = "group"
  UNION ALL SELECT "group", a - 1, a, 1.5, -0.5, 0.3, true FROM g WHERE a > 0 AND b > 0
  UNION ALL SELECT "group", a, a - 1, -1.5::DOUBLE * cos(0.3::DOUBLE) + 0.5::DOUBLE * sin(0.3::DOUBLE), 1.5::DOUBLE * sin(0.3::DOUBLE) + 0.5::DOUBLE * cos(0.3::DOUBLE), -0.3, true FROM g WHERE a > 0 AND b > 0)
SELECT "group", src, dst, {_E} FROM merged"""),
    "session_reposed": with_views(f""", bridge AS (SELECT 1.5::DOUBLE AS x, -0.5::DOUBLE AS y, 0.3::DOUBLE AS yaw), moved AS (SELECT k.robot_id, k.kf_id AS node, {planar_product("b", "k")} FROM keyframes k, bridge b WHERE k.robot_id % 2 = 1)
SELECT robot_id, node, {PLANAR_SQL} FROM moved"""),
    "trajectory_export": with_views(f""", local AS (SELECT robot_id, frame_id, x, y, frame_id * 0.01::DOUBLE AS yaw FROM scan_frames), rows AS (
  SELECT robot_id, kf_id, -1::BIGINT AS frame_id, x, y, yaw FROM keyframes WHERE kf_id % 4 = 0
  UNION ALL SELECT f.robot_id, k.kf_id, f.frame_id, {planar_product("k", "f")} FROM local f JOIN keyframes k ON k.robot_id = f.robot_id AND k.kf_id = f.frame_id - 1 - (f.frame_id - 1) % 4)
SELECT robot_id, kf_id, frame_id, {PLANAR_SQL} FROM rows"""),
    "pose_correction": with_views(_SHAKEN + f""", local AS (SELECT robot_id, frame_id, x, y, frame_id * 0.01::DOUBLE AS yaw FROM scan_frames), newest AS (
  SELECT robot_id, max(kf_id) AS kf_id FROM keyframes GROUP BY 1
), seen AS (
  SELECT f.robot_id, f.frame_id, {planar_relative("k", "f")} FROM local f JOIN newest n USING (robot_id) JOIN keyframes k ON k.robot_id = n.robot_id AND k.kf_id = n.kf_id
), moved AS (
  SELECT v.robot_id, v.frame_id, {planar_product("t", "v")} FROM seen v JOIN newest n ON n.robot_id = v.robot_id JOIN shaken t ON t.robot_id = n.robot_id AND t.kf_id = n.kf_id)
SELECT robot_id, frame_id, {PLANAR_SQL} FROM moved"""),
    "node_degree": with_views("SELECT robot_id, src AS node, count(*) AS degree FROM edges GROUP BY ALL"),
}
