"""Sharding by best-fit-decreasing bin packing of indivisible groups (rows of equal text).

Groups enter, by falling size, the bin of least remaining capacity that holds them, which a balanced
tree of remaining capacities finds. Spark sorts and packs in two levels, so that nothing
grows with the corpus but the work of tasks: tasks pack the groups of a hash partition, sorted by
Spark, into bundles of 1/512 of a shard; then the driver packs the bundles, and the groups that
are larger than a bundle, into shards of the least capacity that does. There are fewer than
512 * shards such groups, and at most about 1.3 * 512 * shards bundles and one for each task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table

SHARDS, PARTS_OF_A_SHARD, SLOT_BUCKETS = 8, 512, 1024
#: Groups that one task packs, about, and tasks at most: each has several bundles.
GROUPS_OF_A_TASK, MOST_TASKS = 20_000, 1024
BUNDLED = "hash long, crc long, none boolean, bytes long, bundle long"


class RoomTree:
    """Bins by remaining room: a search tree of (room, bin) that random priorities keep balanced."""

    def __init__(self):
        self.root, self.draw = None, random.Random(8)

    def _split(self, node, key):
        """(nodes below key, the others)"""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]

    def add(self, room: int, which: int) -> None:
        low, high = self._split(self.root, (room, which))
        self.root = self._merge(self._merge(low, [(room, which), self.draw.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """The (room, bin) of least room that holds size, taken out; None if there is none."""
        low, high = self._split(self.root, (size, -1))
        node = high
        while node is not None and node[2] is not None:
            node = node[2]
        if node is not None:
            _, high = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._merge(low, high)
        return node and node[0]


class BestFit:
    """Bins of equal capacity; an item above it gets a bin of its own."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.tree = capacity, 0, RoomTree()

    def place(self, size: int) -> int:
        found = self.tree.take_tightest(size)
        if found is None:
            found, self.bins = (max(self.capacity, size), self.bins), self.bins + 1
        self.tree.add(found[0] - size, found[1])
        return found[1]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item: by falling size, into the bin of least remaining capacity that holds it, else a new one."""
    bins, out = BestFit(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = bins.place(sizes[i])
    return out


def pack(sizes: list[int], shards: int) -> list[int]:
    """Bins of best-fit-decreasing at the least capacity, found by bisection, that needs `shards` bins at most."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // shards)), 2 * max(max(sizes), -(-sum(sizes) // shards))
    best = best_fit_decreasing(sizes, high)
    while low < high:
        mid = (low + high) // 2
        trial = best_fit_decreasing(sizes, mid)
        if max(trial) < shards:
            best, high = trial, mid
        else:
            low = mid + 1
    return best


def _bundles(capacity: int):
    """A task's groups come by part and falling size; each part is packed by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = bins = None
        for batch in batches:
            parts, out = batch.column("part").to_pylist(), []
            for p, size in zip(parts, batch.column("bytes").to_pylist(), strict=True):
                if p != part:
                    part, bins = p, BestFit(capacity)
                out.append(p << 32 | bins.place(size))
            names = ["hash", "crc", "none", "bytes"]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(out, pa.int64())], names=[*names, "bundle"])

    return run


def shard_documents(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, default all) with size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 1; texts are one item at any length. Rows of
    equal text share a shard; null texts are a group of their own, with a crc of 0. Shards differ by at most
    about one bundle unless one group is larger than a shard's share: groups are never split, so such a
    group fills a shard alone. slot numbers the rows of a shard from 0 without gaps. Null doc_ids and
    repeated rows are ordinary rows; an empty table gives an empty result; columns of docs with
    the names above are replaced.
    """
    spark = docs.sparkSession
    made = ["size", "text_crc32", "shard", "slot"]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns if c.lower() not in made]).alias("row"), F.col("doc_id").alias("id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("crc"), F.xxhash64("text").alias("hash"), F.col("text").isNull().alias("none"),
    )
    group = ["hash", "crc", "none"]
    groups = materialize(rows.groupBy(*group).agg(F.sum("size").alias("bytes")))
    total, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    capacity = max(1, -(-total // (shards * PARTS_OF_A_SHARD)))
    large = groups.where(F.col("bytes") > capacity).orderBy(*group).collect()  # fewer than shards * PARTS_OF_A_SHARD
    tasks = max(1, min(MOST_TASKS, n_groups // GROUPS_OF_A_TASK))
    small = groups.where(F.col("bytes") <= capacity).withColumn("part", F.pmod("hash", F.lit(tasks)).cast("long"))
    bundled = materialize(small.repartition(tasks, "part").sortWithinPartitions("part", F.desc("bytes"), *group).mapInArrow(_bundles(capacity), BUNDLED))
    bundles = bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()
    bins = pack([r.bytes for r in large] + [r.bytes for r in bundles], shards)
    own = spark.createDataFrame([(r.hash, r.crc, r.none, b) for r, b in zip(large, bins, strict=False)], "hash long, crc long, none boolean, own_shard int")
    of_bundle = spark.createDataFrame([(r.bundle, b) for r, b in zip(bundles, bins[len(large) :], strict=True)], "bundle long, bundle_shard int")
    of_group = bundled.drop("bytes").join(F.broadcast(of_bundle), "bundle").select(F.col("hash").alias("key"), "crc", "none", "bundle_shard")
    # rows of large groups have their shard already: they are spread over the join, where they match nothing
    keyed = rows.join(F.broadcast(own), group, "left").withColumn("key", F.when(F.col("own_shard").isNull(), F.col("hash")).otherwise(F.xxhash64("id", "hash")))
    # written, as rows are dealt to parts by where they stand, so that equal rows don't meet in one part
    placed = materialize(keyed.join(of_group, ["key", "crc", "none"], "left").select(
        "row", "id", "size", "crc", "hash", F.coalesce("own_shard", "bundle_shard").alias("shard"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SLOT_BUCKETS)).cast("int").alias("part"),
    ))
    # two levels, so that no shard has to fit in one task: rows before a part, then rows within it
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("shard", "part").orderBy("id", "hash")
    return placed.withColumn("nth", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "part"]).select(
        "row.*", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("nth") - 1).alias("slot")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under law `bytes` over 8 shards; grown_shard is null under that law."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
