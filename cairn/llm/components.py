"""Connected components of a link table, by local union-find and distributed star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Links that one local union-find holds at a time.
LOCAL_LINKS = 500_000
EDGE = "u long, v long"


class UnionFind:
    """Union by smallest label with path halving."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, smallest node of its tree) with the same components as the links u-v."""
    nodes, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    sets = UnionFind(len(nodes))
    for a, b in zip(flat[: len(u)].tolist(), flat[len(u) :].tolist(), strict=True):
        sets.union(a, b)
    roots = np.fromiter((sets.find(i) for i in range(len(nodes))), np.int64, len(nodes))
    keep = roots != np.arange(len(nodes))
    return nodes[keep], nodes[roots[keep]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x[0]) for x in held) >= LOCAL_LINKS:
            held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
            if len(held[0][0]) * 2 > LOCAL_LINKS:  # few links fall away here: pass them on
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), names=["u", "v"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that links (u, v) reach; nodes without a link are absent.

    Each partition first contracts its links to a forest by union-find. Then large-star and
    small-star rounds alternate, each a shuffle of the remaining links, until every node points
    at its root; a round's links are written to the shared folder. Self links and repeated
    links are allowed, an empty table gives an empty one.
    """
    links = materialize(links.where("u <> v").mapInArrow(_local, EDGE).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has a shuffle of its own, which Spark can split at a hub
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        # large star: neighbours above u move to the least neighbour of u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the neighbours below u, and u, move to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        new = materialize(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").mapInArrow(_local, EDGE).distinct()
        )
        # stars only: no node is both a leaf and a root, and each leaf has one root
        roots, leaves = new.select(F.col("v").alias("u")), new.select("u")
        if not roots.join(leaves, "u", "left_semi").take(1) and not new.groupBy("u").count().where("count > 1").take(1):
            break
        links = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
