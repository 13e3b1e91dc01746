"""Pose-graph operators on edge tables (robot_id, src, dst, pose, reachable); pose(dst) = pose(src) * pose of the edge.

Poses are rigid transforms as arrays of 16 cells (functions.pose). A node is reached once, at its least hop,
from the smallest parent. Graphs whose edges fit in a task, which is checked, are traversed side by side, one
graph per group, in one job. Larger ones take joins for all graphs at once, each round's result written to the shared
folder: a frontier loop, one round a hop, if few hops are asked for. Otherwise nodes with at most two neighbours are
taken out, a share of them at a time, so that a chain of n nodes needs about log n rounds; what is left is relaxed until
nothing changes, the nodes taken out are put back, and transforms are composed over 1, 2, 4, ... hops. No path is too
long for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import pose as P
from cairn.sources.shared import materialize

#: Hops up to which a bounded traversal goes hop by hop.
FEW_HOPS = 32
#: Edges of the largest graph up to which each graph is traversed in a task of its own.
TASK_EDGES = 500_000


def traverse(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """(robot_id, node, hop, parent, pose): breadth-first from seeds(robot_id, node, pose), with composed transforms."""
    largest = edges.groupBy("robot_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= task_edges:
        return _by_graph(edges, seeds, max_hops)
    if max_hops is not None and max_hops <= FEW_HOPS:
        return _by_frontier(edges, seeds, max_hops)
    every = _by_contraction(edges, seeds)
    return every if max_hops is None else every.where(F.col("hop") <= max_hops)


def _matrices(poses: pd.Series) -> np.ndarray:
    return np.array(poses.tolist(), float).reshape(-1, 4, 4)


def _by_graph(edges: DataFrame, seeds: DataFrame, max_hops: int | None) -> DataFrame:
    def run(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        ids, where = np.unique(np.concatenate((e["src"], e["dst"], s["node"])).astype(np.int64), return_inverse=True)
        src, dst, own = np.split(where, (len(e), 2 * len(e)))
        steps = _matrices(e["pose"])
        order = np.lexsort((*steps.reshape(len(e), 16).T[::-1], dst, src))  # repeated edges: the least transform counts
        src, dst, steps = src[order], dst[order], steps[order]
        first = np.searchsorted(src, np.arange(len(ids) + 1))
        hop, parent, pose = np.full(len(ids), -1), np.full(len(ids), -1), np.zeros((len(ids), 4, 4))
        hop[own], pose[own] = 0, _matrices(s["pose"])
        front, at = np.unique(own), 0
        while len(front) and (max_hops is None or at < max_hops):
            n = first[front + 1] - first[front]
            way = np.repeat(first[front] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            way = way[hop[dst[way]] < 0]
            way = way[np.lexsort((way, dst[way]))]  # ways are in order of their source
            way = way[np.concatenate(([True], dst[way][1:] != dst[way][:-1]))] if len(way) else way
            front, at = dst[way], at + 1
            hop[front], parent[front], pose[front] = at, ids[src[way]], pose[src[way]] @ steps[way]
        seen = np.flatnonzero(hop >= 0)
        return pd.DataFrame({
            "robot_id": s["robot_id"].iloc[0] if len(s) else 0, "node": ids[seen], "hop": hop[seen],
            "parent": pd.arrays.IntegerArray(parent[seen].astype(np.int64), hop[seen] == 0),
            "pose": pd.Series(pose[seen].reshape(-1, 16).tolist(), dtype=object)})

    a = edges.select("robot_id", "src", "dst", "pose").toDF("robot_id", "src", "dst", "pose")  # renamed, as both sides may come from one table
    return a.groupBy("robot_id").cogroup(seeds.select("robot_id", "node", "pose").groupBy("robot_id")).applyInPandas(run, "robot_id long, node long, hop int, parent long, pose array<double>")


def _by_frontier(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    seen = materialize(seeds.select("robot_id", "node", F.lit(0).alias("hop"), F.lit(None).cast("long").alias("parent"), "pose"))
    e = materialize(edges.select("robot_id", F.col("src").alias("node"), "dst", F.col("pose").alias("step")))
    for hop in range(1, max_hops + 1):
        ways = seen.where(F.col("hop") == hop - 1).join(e, ["robot_id", "node"]).select("robot_id", F.col("dst").alias("node"), F.struct(F.col("node").alias("parent"), "step", "pose").alias("s"))
        new = ways.join(seen.select("robot_id", "node"), ["robot_id", "node"], "left_anti").groupBy("robot_id", "node").agg(F.min("s").alias("s"))
        grown = materialize(seen.unionByName(new.select("robot_id", "node", F.lit(hop).alias("hop"), "s.parent", P.product(F.col("s.pose"), F.col("s.step")).alias("pose"))))
        if not grown.where(F.col("hop") == hop).take(1):
            break
        seen = grown
    return seen


def compose_up(links: DataFrame) -> DataFrame:
    """links(robot_id, node, up, pose, ...) with poses composed up to the roots, which have no `up`; in log2 of the longest chain's rounds."""
    at = materialize(links)
    rest = [F.col(c) for c in links.columns if c not in ("up", "pose")]
    while at.where("up is not null").take(1):
        over = at.select("robot_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("pose").alias("pose2"))
        longer = at.where("up is not null").join(over, ["robot_id", "up"]).select(*rest, F.col("up2").alias("up"), P.product(F.col("pose2"), F.col("pose")).alias("pose"))
        at = materialize(at.where("up is null").unionByName(longer))
    return at.drop("up")


def _contract(e: DataFrame, seeds: DataFrame, turn: int) -> tuple[DataFrame, DataFrame] | None:
    """(edges, ways): edges (robot_id, src, dst, w) without some nodes of at most two neighbours, none beside another, with
    edges around them in their place; ways (robot_id, src, node, w) into these nodes. None if there is no such node."""
    links = e.select("robot_id", F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select("robot_id", F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    few = links.groupBy("robot_id", "node").agg(F.count("*").alias("n"), F.min("other").alias("a"), F.max("other").alias("b")).where("n <= 2").join(seeds, ["robot_id", "node"], "left_anti")
    few = materialize(few.withColumn("rank", F.struct(F.xxhash64("robot_id", "node", F.lit(turn)).alias("h"), F.col("node").alias("v"))))
    rank = few.select("robot_id", F.col("node").alias("other"), F.col("rank").alias("other_rank"))
    beside = few.select("robot_id", "node", "rank", F.explode(F.array_distinct(F.array("a", "b"))).alias("other")).join(rank, ["robot_id", "other"]).where("other_rank < rank")
    out = materialize(few.select("robot_id", "node").join(beside.select("robot_id", "node"), ["robot_id", "node"], "left_anti"))
    if not out.take(1):
        return None
    ways = materialize(e.withColumnRenamed("dst", "node").join(out, ["robot_id", "node"]).select("robot_id", "src", "node", "w"))
    on = e.withColumnRenamed("src", "node").join(out, ["robot_id", "node"]).select("robot_id", "node", "dst", F.col("w").alias("w2"))
    around = ways.join(on, ["robot_id", "node"]).where("src <> dst").select("robot_id", "src", "dst", (F.col("w") + F.col("w2")).alias("w"))
    rest = e
    for end in ("src", "dst"):
        rest = rest.join(out.select("robot_id", F.col("node").alias(end)), ["robot_id", end], "left_anti")
    return materialize(rest.unionByName(around).groupBy("robot_id", "src", "dst").agg(F.min("w").alias("w"))), ways


def hop_counts(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(robot_id, node, d): the least number of edges from a seed, for the nodes that have a way from one."""
    start = materialize(seeds.select("robot_id", "node").distinct())
    e = materialize(edges.where("src <> dst").select("robot_id", "src", "dst", F.lit(1).cast("long").alias("w")).distinct())
    taken: list[DataFrame] = []
    while (step := _contract(e, start, len(taken))) is not None:
        e, ways = step
        taken.append(ways)
    found = moved = start.withColumn("d", F.lit(0).cast("long"))
    while True:
        reached = moved.withColumnRenamed("node", "src").join(e, ["robot_id", "src"]).groupBy("robot_id", F.col("dst").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
        moved = materialize(reached.join(found, ["robot_id", "node"], "left").where("d is null or new < d").select("robot_id", "node", F.col("new").alias("d")))
        if not moved.take(1):
            break
        found = materialize(found.unionByName(moved).groupBy("robot_id", "node").agg(F.min("d").alias("d")))
    for ways in reversed(taken):
        back = ways.join(found.withColumnRenamed("node", "src"), ["robot_id", "src"]).groupBy("robot_id", "node").agg(F.min(F.col("d") + F.col("w")).alias("d"))
        found = materialize(found.unionByName(back))
    return found


def _by_contraction(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The traversal of any length: hops first, then parents, then transforms over 1, 2, 4, ... hops."""
    d = hop_counts(edges, seeds)
    near, far = d.toDF("robot_id", "src", "from"), d.toDF("robot_id", "dst", "hop")
    ways = edges.select("robot_id", "src", "dst", "pose").join(near, ["robot_id", "src"]).join(far, ["robot_id", "dst"]).where(F.col("hop") == F.col("from") + 1)
    best = ways.groupBy("robot_id", F.col("dst").alias("node"), "hop").agg(F.min(F.struct("src", "pose")).alias("s"))
    none = F.lit(None).cast("long")
    first = seeds.select("robot_id", "node", F.lit(0).cast("long").alias("hop"), none.alias("parent"), none.alias("up"), "pose")
    at = compose_up(first.unionByName(best.select("robot_id", "node", "hop", F.col("s.src").alias("parent"), F.col("s.src").alias("up"), "s.pose")))
    return at.select("robot_id", "node", F.col("hop").cast("int").alias("hop"), "parent", "pose")


def link_nodes(edges: DataFrame, nodes: DataFrame, fixed: int = 0) -> DataFrame:
    """Poses of all nodes that the fixed node reaches, which itself is at the origin. Raises if a graph lacks it."""
    origin = nodes.where(F.col("node") == fixed).select("robot_id", "node", P.identity().alias("pose"))
    if nodes.select("robot_id").distinct().join(origin, "robot_id", "left_anti").take(1):
        raise ValueError(f"fixed node {fixed} is missing in some graph")
    return traverse(edges, origin)


def pose_by_scan(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(robot_id, node, pose) of nodes that are read in the order of their ids: each takes its pose from its first
    neighbour that was read before, pose(neighbour) * edge^-1; one without takes its own of known(robot_id, node, pose).
    Neighbours that known lacks aren't in the map: edges to them are passed over."""
    there = edges.where("dst < src").join(known.select("robot_id", F.col("node").alias("dst")), ["robot_id", "dst"], "left_semi")
    before = there.groupBy("robot_id", F.col("src").alias("node")).agg(F.min(F.struct("dst", "pose")).alias("s"))
    placed = known.select("robot_id", "node", F.col("pose").alias("own")).join(before, ["robot_id", "node"], "left")
    return compose_up(placed.select("robot_id", "node", F.col("s.dst").alias("up"), F.when(F.col("s").isNull(), F.col("own")).otherwise(P.inverse(F.col("s.pose"))).alias("pose")))


def neighbour_search(edges: DataFrame, centres: DataFrame, depth: int | None) -> DataFrame:
    """Nodes within `depth` hops (None: any number) of centres(robot_id, node), the centre included at hop 0, with poses relative to it."""
    return traverse(edges, centres.select("robot_id", "node", P.identity().alias("pose")), depth)


def shortest_path(edges: DataFrame, ends: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Fewest-hop path for ends(robot_id, source, target): (robot_id, step, node, pose), relative to the source; nothing if there is none."""
    tree = materialize(neighbour_search(edges, ends.select("robot_id", F.col("source").alias("node")), max_hops))
    path = materialize(tree.join(ends.select("robot_id", F.col("target").alias("node")), ["robot_id", "node"]).select("robot_id", "node", "hop"))
    longest = path.agg(F.max("hop")).first()[0] or 0
    # ancestors 1, 2, 4, ... hops up; their sums give every ancestor of the target once
    jumps = [tree.where("parent is not null").select("robot_id", "node", "parent")]
    while 2 ** len(jumps) <= longest:
        jumps.append(materialize(jumps[-1].join(jumps[-1].toDF("robot_id", "parent", "over"), ["robot_id", "parent"]).select("robot_id", "node", F.col("over").alias("parent"))))
    path = path.select("robot_id", "node")
    for jump in reversed(jumps):
        path = materialize(path.unionByName(path.join(jump, ["robot_id", "node"]).select("robot_id", F.col("parent").alias("node"))))
    return path.join(tree, ["robot_id", "node"]).select("robot_id", F.col("hop").alias("step"), "node", "pose")


def insert_absent(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Adds new edges where the pair isn't linked yet: the old one stays."""
    return edges.unionByName(new.join(edges.select("robot_id", "src", "dst"), ["robot_id", "src", "dst"], "left_anti"))


def upsert(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces linked pairs by the new edges."""
    return edges.join(new.select("robot_id", "src", "dst"), ["robot_id", "src", "dst"], "left_anti").unionByName(new)


def _forth_and_back(src, dst, pose: Column) -> Column:
    """An edge and its reverse, as rows."""
    return F.explode(F.array(F.struct(src.alias("src"), dst.alias("dst"), pose.alias("pose")), F.struct(dst.alias("src"), src.alias("dst"), P.inverse(pose).alias("pose"))))


def _ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the poses of both ends (a, b); edges without both go."""
    a, b = (nodes.select("robot_id", F.col("node").alias(end), F.col("pose").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    return edges.join(a, ["robot_id", "src"]).join(b, ["robot_id", "dst"])


def both_ways(loops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Two edges for each (robot_id, src, dst), with the transform between the nodes' poses; both reachable."""
    t = _ends(loops.select("robot_id", "src", "dst"), nodes)
    return t.select("robot_id", _forth_and_back(F.col("src"), F.col("dst"), P.relative(F.col("a"), F.col("b"))).alias("e")).select("robot_id", "e.*", F.lit(True).alias("reachable"))


def refresh(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with transforms from the nodes' current poses; edges without both ends go."""
    return _ends(edges.select("robot_id", "src", "dst", "reachable"), nodes).select("robot_id", "src", "dst", P.relative(F.col("a"), F.col("b")).alias("pose"), "reachable")


def optimizable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reachable edges with both ends present."""
    out = edges.where("reachable")
    for end in ("src", "dst"):
        out = out.join(nodes.select("robot_id", F.col("node").alias(end)), ["robot_id", end], "left_semi")
    return out


def close_circle(edges: DataFrame, nodes: DataFrame, from_origin: bool = False) -> DataFrame:
    """Adds edges between the first and the last node of a graph, each way unless that node has a neighbour more than one id apart.

    from_origin, the other rule: both are added unless the first is linked to the last; their transform is the last node's own pose and its inverse, as if the first
    lay at the origin."""
    span = nodes.groupBy("robot_id").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    there, back = F.struct(F.col("first").alias("src"), F.col("last").alias("dst")), F.struct(F.col("last").alias("src"), F.col("first").alias("dst"))
    ways = lambda df: df.select("robot_id", F.explode(F.array(there, back)).alias("e")).select("robot_id", "e.*", F.lit(True).alias("reachable"))
    if from_origin:
        new = ways(span.join(edges.select("robot_id", F.col("src").alias("first"), F.col("dst").alias("last")), ["robot_id", "first", "last"], "left_anti"))
        end = nodes.select("robot_id", F.col("node").alias("end"), F.col("pose").alias("own"))
        placed = new.withColumn("end", F.greatest("src", "dst")).join(end, ["robot_id", "end"])
        new = placed.select("robot_id", "src", "dst", F.when(F.col("src") < F.col("dst"), F.col("own")).otherwise(P.inverse(F.col("own"))).alias("pose"), "reachable")
    else:
        far = edges.where(F.abs(F.col("src") - F.col("dst")) > 1).select("robot_id", "src").distinct()
        new = refresh(ways(span).join(far, ["robot_id", "src"], "left_anti"), nodes)
    return insert_absent(edges, new.select(*edges.columns))


def merge_sessions(first: DataFrame, second: DataFrame, by: DataFrame, bridge: Column) -> DataFrame:
    """Edges of two sessions in one graph (group, src, dst, pose, reachable).

    first, second: (group, src, dst, pose, reachable); by: (group, n_first, n_second), the number of nodes. Ids of
    the second go up by n_first; the last node of the first and the first of the second are linked by the bridge and its inverse.
    """
    columns = ["group", "src", "dst", "pose", "reachable"]
    moved = second.join(by, "group").select("group", (F.col("src") + F.col("n_first")).alias("src"), (F.col("dst") + F.col("n_first")).alias("dst"), "pose", "reachable")
    links = by.where("n_first > 0 and n_second > 0").select("group", _forth_and_back(F.col("n_first") - 1, F.col("n_first"), bridge).alias("e")).select("group", "e.*", F.lit(True).alias("reachable"))
    return first.select(*columns).unionByName(moved).unionByName(links)


def repose(nodes: DataFrame, origin: Column) -> DataFrame:
    """Poses of a session whose own origin is at `origin`: origin * pose."""
    return nodes.withColumn("pose", P.product(origin, F.col("pose")))


def anchor_session(reference: DataFrame) -> DataFrame:
    """Two edges that tie a new session's first keyframe to a node of an old map where it was found, (robot_id, old, new): identity, both reachable."""
    return reference.select("robot_id", _forth_and_back(F.col("old"), F.col("new"), P.identity()).alias("e")).select("robot_id", "e.*", F.lit(True).alias("reachable"))


def trajectory(nodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows for a trajectory file: each keyframe's own row, then its frames, placed at pose(keyframe) * pose(frame)."""
    own = nodes.select("robot_id", F.col("node").alias("kf_id"), F.lit(-1).cast("long").alias("frame_id"), "pose")
    inner = frames.join(nodes.select("robot_id", F.col("node").alias("kf_id"), F.col("pose").alias("at")), ["robot_id", "kf_id"])
    return own.unionByName(inner.select("robot_id", "kf_id", "frame_id", P.product(F.col("at"), F.col("pose")).alias("pose")))


def correct_current(nodes: DataFrame, optimized: DataFrame, current: DataFrame) -> DataFrame:
    """Pose of the current frame after its newest keyframe moved from `nodes` to `optimized`: optimized * unoptimized^-1 * current."""
    newest = nodes.groupBy("robot_id").agg(F.max_by(F.struct("node", "pose"), "node").alias("k")).select("robot_id", "k.node", F.col("k.pose").alias("was"))
    shift = newest.join(optimized.select("robot_id", "node", F.col("pose").alias("now")), ["robot_id", "node"]).select("robot_id", P.product(F.col("now"), P.inverse(F.col("was"))).alias("shift"))
    return current.join(shift, "robot_id").select("robot_id", "frame_id", P.product(F.col("shift"), F.col("pose")).alias("pose"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("robot_id", F.col("src").alias("node")).agg(F.count("*").alias("degree"))
