"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

1. One scan makes a SuperMinHash signature of each document's word shingles, and a 128-bit
   digest of the shingle set; documents with the same set are one node from here on.
2. Bands of the signature are bucketed. Each bucket first sends its nodes to its least node, the
   centre: pairs (centre, node) are verified on full shingle sets and joined by union-find. A centre
   that very many nodes name is split into slices, each a task of its own.
3. A bucket whose other nodes are in one component by now is done: the usual case, as chance
   meetings have two nodes and copies all link. In the others, nodes outside the bucket's largest
   component are compared with one another and with that component, in blocks of bounded
   size by an inverted index. The component isn't compared with itself, so a few odd nodes in a
   huge bucket cost one pass over it. Tasks emit a spanning forest of the confirmed links.
4. Components of all confirmed links are the groups.

Work follows the buckets, which nothing chains together. It is quadratic only where many nodes of one
bucket stay apart, in blocks: every pair of them is a candidate then.

The number of bands follows from the threshold: a pair at the threshold misses every band with
a chance of at most `miss`. Nothing is capped: every bucket, cluster and set is used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import UnionFind, connected_components
from .shared import bounded_batches, materialize, table
from .textkit import Words, mix64, shingles, text_slices

#: Slots per band, and the chance with which a pair at the threshold may miss every band.
BAND_ROWS, MISS = 6, 1e-7
#: Shingles and nodes in a block of the exact comparison, nodes that meet a centre in one slice, and shingles that one permutation table holds.
BLOCK_SHINGLES, BLOCK_NODES, SLICE_NODES, TABLE_SHINGLES = 100_000, 512, 256, 1 << 15
NODE_COLUMNS = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"


def band_count(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def superminhash(items: np.ndarray, ptr: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (row x slot) of the items of each row.

    Round j draws for each item a fraction r and the j-th entry of the item's own random
    permutation of the slots, and offers j + r to that slot. Values of later rounds are larger,
    so a row is done once no slot holds more than the rounds so far: early stopping. Values are
    j in the high 8 bits and r in the low 24.
    """
    rows = len(ptr) - 1
    out = np.full((rows, slots), 0xFFFFFFFF, np.uint32)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(rows), np.diff(ptr))
    order = np.arange(slots, dtype=np.uint8)
    table_ = np.empty((min(len(items), TABLE_SHINGLES), slots), np.uint8)
    for a in range(0, len(items), TABLE_SHINGLES):
        item, own = items[a : a + TABLE_SHINGLES], owner[a : a + TABLE_SHINGLES]
        live = np.arange(len(item))
        for j in range(slots):
            draw = mix64(item + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            value = (draw >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24)
            pick = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
            if j == 0:
                slot = pick
            else:
                if j == 1:  # the first round only needs the slot itself: now its swap is entered
                    table_[live] = order
                    table_[live, first] = 0
                    table_[live, 0] = first
                slot = table_[live, pick]
                table_[live, pick] = table_[live, j]
                table_[live, j] = slot
            np.minimum.at(flat, own * slots + slot, value)
            if j == 0:
                first = pick.astype(np.uint8)
            here = np.unique(own)
            open_ = here[out[here].max(axis=1) >= np.uint32((j + 1) << 24)] if j < slots - 1 else here[:0]
            if not len(open_):
                break
            if len(open_) < len(here):
                keep = np.isin(own, open_)
                item, own, live = item[keep], own[keep], live[keep]
                if j == 0:
                    first = first[keep]
    return out


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for at, end, data, offsets in text_slices(batch):
                sh, ptr = shingles(Words(data, offsets, lower=True), k)
                sig = superminhash(sh, ptr, bands * rows)
                mixed = np.tile(np.arange(bands, dtype=np.uint64) << np.uint64(32), (end - at, 1))  # so that a bucket tells its band
                for r in range(rows):
                    mixed = mix64(mixed + sig[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
                size, hi, lo = (np.zeros(end - at, kind) for kind in (np.int64, np.uint64, np.uint64))
                for i in range(end - at):
                    own = distinct(sh[ptr[i] : ptr[i + 1]])
                    size[i], hi[i], lo[i] = len(own), mix64(own).sum(), mix64(own + np.uint64(0x5851F42D4C957F2D)).sum()
                flat = pa.array(mixed.view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), pa.array(size), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, (end - at + 1) * bands, bands, dtype=np.int32)), flat)],
                    names=["doc_id", "n_shingles", "set_hi", "set_lo", "bands"],
                )

    return run


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def linked_forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links with 100 * intersection >= percent * union among members.

    side: 0 everywhere compares all members; with 0 and 1, only members of different sides.
    The inverted index yields all intersections of one member with the earlier ones at once.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    member = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets)
    order = np.argsort(items, kind="stable")
    items, post = items[order], member[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))  # where an entry stands within its posting list
    head = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
    heads = np.repeat(head, np.diff(np.concatenate((head, [len(items)]))))
    ends = np.cumsum(sizes)
    tree = UnionFind(len(sets))
    split = side.any()
    for x in range(1, len(sets)):
        r = rank[ends[x] - sizes[x] : ends[x]]
        lo = heads[r]
        n = r - lo  # members are in order within a posting list: those before x come first
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
        shared = np.bincount(post[at], minlength=x)
        hits = np.flatnonzero(100 * shared >= percent * (sizes[:x] + sizes[x] - shared)) if len(shared) == x else np.flatnonzero(100 * shared[:x] >= percent * (sizes[:x] + sizes[x] - shared[:x]))
        for y in hits.tolist():
            if not split or side[x] != side[y]:
                tree.union(x, y)
    root = np.fromiter((tree.find(i) for i in range(len(sets))), np.int64, len(sets))
    keep = root != np.arange(len(sets))
    return ids[keep], ids[root[keep]]


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingles) of the batch's texts."""
    for at, end, data, offsets in text_slices(batch):
        sh, ptr = shingles(Words(data, offsets, lower=True), k)
        for i in range(end - at):
            yield at + i, distinct(sh[ptr[i] : ptr[i + 1]])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm_stars(k: int, percent: int):
    """Rows come by (center, slice), those of the centre itself first: they stay, the others pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, {}
        for batch in batches:
            centers, slices, docs, first = (batch.column(c).to_pylist() for c in ("center", "slice", "doc_id", "is_center"))
            u, v = [], []
            for i, found in _sets(batch, k):
                if (centers[i], slices[i]) != key:
                    key, own = (centers[i], slices[i]), {}
                if first[i]:
                    own[found.tobytes()] = found
                elif any(similar(found, x, percent) for x in own.values()):
                    u.append(docs[i])
                    v.append(centers[i])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _confirm_blocks(k: int, percent: int):
    """Tasks read rows sorted by (bucket, block_a, block_b), one group after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, side = None, [], [], []

        def flush():
            if len(sets) > 1:
                u, v = linked_forest(np.array(ids, np.int64), sets, np.array(side), percent)
                if len(u):
                    return [pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])]
            return []

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_numpy().tolist() for c in ("bucket", "block_a", "block_b")), strict=True))
            block, doc = batch.column("block").to_numpy(), batch.column("doc_id").to_numpy()
            for i, own in _sets(batch, k):
                if keys[i] != key:
                    yield from flush()
                    key, ids, sets, side = keys[i], [], [], []
                if len(own):
                    ids.append(doc[i])
                    sets.append(own)
                    side.append(int(block[i] != key[1]))
        yield from flush()

    return run


def _star_links(docs: DataFrame, pairs: DataFrame, k: int, percent: int, block_shingles: int) -> DataFrame:
    """Confirmed links of pairs (center, node, n_shingles)."""
    slices = pairs.groupBy("center").agg(F.greatest(F.ceil(F.sum("n_shingles") / block_shingles), F.ceil(F.count("*") / SLICE_NODES)).cast("int").alias("slices"))
    nodes = pairs.join(slices, "center").select(F.col("node").alias("doc_id"), "center", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), F.lit(False).alias("is_center"))
    centers = slices.select(F.col("center").alias("doc_id"), "center", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("is_center"))
    fetched = docs.hint("merge").join(nodes.unionByName(centers), "doc_id").select("center", "slice", "is_center", "doc_id", "text")
    return fetched.repartition("center", "slice").sortWithinPartitions("center", "slice", F.desc("is_center")).mapInArrow(_confirm_stars(k, percent), "u long, v long")


def _open_links(docs: DataFrame, members: DataFrame, components: DataFrame, k: int, percent: int, block_shingles: int) -> DataFrame:
    """Confirmed links between the components that meet in a bucket; members: (bucket, node, n_shingles)."""
    known = members.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    weight = F.col("n_shingles") / block_shingles + F.lit(1 / BLOCK_NODES)  # share of a block that a node takes
    parts = known.groupBy("bucket", "component").agg(F.sum(weight).alias("n"))
    # the largest component is told apart from the odd ones; a bucket of one component is done
    shape = parts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    shape = materialize(shape.where("parts > 1").select(
        "bucket", "main", F.ceil(F.greatest(F.col("n") - F.col("main_n"), F.lit(1 / BLOCK_NODES))).cast("int").alias("odd_blocks"), F.ceil("main_n").cast("int").alias("main_blocks")))
    odd = F.col("component") != F.col("main")
    spread = F.xxhash64("node")
    placed = known.join(shape, "bucket").select(
        F.col("node").alias("doc_id"), "bucket",
        F.when(odd, F.pmod(spread, "odd_blocks")).otherwise(F.col("odd_blocks") + F.pmod(spread, "main_blocks")).cast("int").alias("block"),
        F.when(odd, F.col("odd_blocks") + F.col("main_blocks")).otherwise(F.col("odd_blocks")).alias("others"))
    asked = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(
        "doc_id", "bucket", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block")
    keys = ["bucket", "block_a", "block_b"]
    return docs.hint("merge").join(asked, "doc_id").select(*keys, "block", "doc_id", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_confirm_blocks(k, percent), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = BAND_ROWS, miss: float = MISS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...).

    A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; a document's set has its distinct
    k-word shingles, or its whole word sequence if it has fewer words. Documents are linked
    where 100 * intersection >= percent * union. component_id is the smallest doc_id that links
    reach; kept is doc_id = component_id.

    Null or empty texts and texts without words have no shingles and link with nothing. Rows of
    a null doc_id get a null component_id, link with nothing and are kept. Rows that repeat a
    doc_id are one document in links and each get a result row. Other columns are ignored, so
    their names can't clash. A text of any length is one set; what is held of it is its words' hashes and
    its shingles. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands = band_count(percent / 100, rows, miss)
    if bands * rows > 255:
        raise ValueError(f"{bands} bands of {rows} rows: at most 255 slots")
    nodes = materialize(docs.mapInArrow(_signatures(k, bands, rows), NODE_COLUMNS))
    sets = nodes.where("n_shingles > 0 and doc_id is not null").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("node"))
    sets = materialize(sets)
    reps = nodes.join(sets.select("set_hi", "set_lo", F.col("node").alias("doc_id")), ["set_hi", "set_lo", "doc_id"], "left_semi")
    banded = reps.select(F.col("doc_id").alias("node"), "n_shingles", F.explode("bands").alias("bucket"))
    # written, so that the join has a shuffle of its own, which Spark can split at a hot bucket
    # a doc_id that several rows have may be there with several sets
    stars = materialize(banded.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("least"), F.max(F.struct(-F.col("node"), "n_shingles")).alias("most"), F.count("*").alias("n")).where("n > 1").select(
        "bucket", F.col("least.node").alias("center"), F.col("least.n_shingles").alias("center_least"), F.col("most.n_shingles").alias("center_most")))
    members = materialize(banded.join(stars, "bucket").where("node <> center"))
    # texts of all nodes that meet another, fetched once; neither side has a bound on its size: merge joins at every size
    meeting = members.select(F.explode(F.array("center", "node")).alias("doc_id")).distinct()
    docs = materialize(docs.hint("merge").join(meeting, "doc_id", "left_semi"))
    near_in_size = (100 * F.col("n_shingles") >= percent * F.col("center_least")) & (100 * F.col("center_most") >= percent * F.col("n_shingles"))
    links = materialize(_star_links(docs, members.where(near_in_size).select("center", "node", "n_shingles").distinct(), k, percent, block_shingles))
    odd_links = _open_links(docs, members.select("bucket", "node", "n_shingles"), connected_components(links), k, percent, block_shingles)
    groups = connected_components(links.unionByName(odd_links))
    known = sets.join(groups, "node", "left").select("set_hi", "set_lo", F.coalesce("component", "node").alias("component_id"))
    return nodes.select("doc_id", "n_shingles", "set_hi", "set_lo").join(known, ["set_hi", "set_lo"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three-word shingle sets with a similarity of 0.85 or more, over all documents (see near_duplicates)."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
