"""Exact top-k search by inner product, by elimination with a table of distances to pivots.

Inner products become distances by one more component: x' = (x, sqrt(m - |x|^2)) and q' = (q, 0), where m is the largest |x|^2,
have |q' - x'|^2 = |q|^2 + m - 2 <q, x>, so the nearest are those of the largest products. For any pivot p, |d(q', p') - d(x', p')|
is a lower bound of d(q', x'); the largest over all pivots is kept for elimination.

Vectors are sorted by their nearest pivot and their distance to it and packed in blocks, 16 blocks a shelf at most, each with
its vectors' distances to all pivots and their range. A query first meets the shelf that it stands on, which gives it ten
scores to beat, and then the shelves whose ranges leave room for a score as high, each in its own task. Within a
shelf blocks and candidates are eliminated by their bounds, and the rest is evaluated in the order of bounds until the next bound is
beyond the tenth score. Scores are whole numbers, bounds are given the slack of their rounding, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize, table

SCALE, TOP, EVERY = 1024, 10, 100
#: Pivots are spread out among so many vectors of least hash.
PIVOTS, PIVOT_SAMPLE = 32, 2048
#: Bytes of a block's cells, and blocks of a shelf: a task holds one shelf.
BLOCK_BYTES, SHELF_BLOCKS = 1 << 21, 16
#: Shelves' ranges that go to the tasks at once, and queries that one task takes to a shelf.
RANGES, QUERIES_OF_A_TASK = 1 << 15, 1 << 16
#: Candidates that are evaluated at a time, and the rounding of a bound as a share of the largest distance.
STEP, SLACK = 2048, 1e-6
VECTOR = "vec_id long, cells binary, pivot_dist binary, near int, dist float"
BLOCK = "part long, block int, n int, ids binary, named binary, cells binary, pivot_dist binary, low array<float>, high array<float>"
QUERY = "query long, query_id long, part long, query_cells binary, floor long"
FOUND = "query long, query_id long, vec_id long, score long"


class Space:
    """Whole vectors of `dim` cells, and their distances to the pivots. Goes to the tasks: a few pivots."""

    def __init__(self, dim: int, most: int, longest: float, pivots: np.ndarray):
        self.dim, self.pivots, self.longest = dim, pivots.astype(np.float64), longest
        self.stored = np.int32 if most < 1 << 31 else np.int64
        self.exact = np.float64 if most * most * dim < 1 << 53 else np.int64  # sums of products are whole in either
        self.rest = np.sqrt(np.maximum(longest - (self.pivots**2).sum(1), 0))
        self.slack = SLACK * (2 * np.sqrt(longest) + 1)

    def distances(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """A row for each vector, as a query or as a candidate."""
        x = vectors.astype(np.float64)
        square = (x * x).sum(1)[:, None]
        rest = 0 if query else np.sqrt(np.maximum(self.longest - square, 0))
        return np.sqrt(np.maximum(square + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T + (rest - self.rest) ** 2, 0))

    def reach(self, query: np.ndarray, floor: float) -> float:
        """The distance of a candidate that scores floor."""
        square = float((query.astype(np.float64) ** 2).sum()) + self.longest
        return float(np.sqrt(max(square - 2 * floor, 0))) + self.slack

    def read(self, cells: bytes) -> np.ndarray:
        return np.frombuffer(cells, self.stored).reshape(-1, self.dim)

    def unpacked(self, lists: pa.Array) -> np.ndarray:
        """Lists of cells as rows, short ones with zeros behind."""
        out = np.zeros((len(lists), self.dim), self.stored)
        sizes = np.diff(lists.offsets.to_numpy())
        out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        return out


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of sample at most, each the farthest from those before."""
    x = sample.astype(np.float64)
    chosen, gap = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def whole_cells(vectors: DataFrame) -> DataFrame:
    """(vec_id, whole: floor(1024 * x) of each component) of vectors that have only finite components."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("whole"))


def _measured(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = space.unpacked(batch.column("whole"))
            far = space.distances(cells).astype(np.float32)
            near = far.argmin(1)
            raw = [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (cells, far)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *raw, pa.array(near, pa.int32()), pa.array(far[np.arange(len(far)), near])], names=["vec_id", "cells", "pivot_dist", "near", "dist"])

    return run


def _packed(space: Space, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(got: pa.Table, at: int) -> pa.RecordBatch:
            ids = got.column("vec_id").combine_chunks()
            far = np.frombuffer(b"".join(got.column("pivot_dist").to_pylist()), np.float32).reshape(got.num_rows, -1)
            values = [
                part << 20 | at // SHELF_BLOCKS, at % SHELF_BLOCKS, got.num_rows, np.asarray(ids.fill_null(0)).tobytes(), np.asarray(ids.is_valid()).tobytes(),
                b"".join(got.column("cells").to_pylist()), np.ascontiguousarray(far.T).tobytes(), far.min(0), far.max(0),
            ]
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.float32())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

        held, n, at, part = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("place")[0].as_py()
            held.append(batch)
            n += batch.num_rows
            while n >= rows:
                got = pa.Table.from_batches(held)
                yield block(got.slice(0, rows), at)
                held, n, at = got.slice(rows).to_batches(), n - rows, at + 1
        if n:
            yield block(pa.Table.from_batches(held), at)

    return run


def _queries(space: Space, every: int):
    """Rows whose id is divisible by `every`, as queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids, cells = np.frombuffer(b["ids"], np.int64), space.read(b["cells"])
                at = np.flatnonzero(np.frombuffer(b["named"], bool) & (ids % every == 0))
                number = (b["part"] * SHELF_BLOCKS + b["block"] << 20) + at  # of this row alone
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), pa.array(ids[at]), pa.array(np.full(len(at), b["part"])), pa.array([cells[i].tobytes() for i in at], pa.binary()), pa.nulls(len(at), pa.int64())],
                    names=[c.split()[0] for c in QUERY.split(", ")])

    return run


class Shelf:
    """A shelf's blocks in a task."""

    def __init__(self, space: Space, blocks: list[dict]):
        self.space = space
        self.ids = np.concatenate([np.frombuffer(b["ids"], np.int64) for b in blocks])
        self.named = np.concatenate([np.frombuffer(b["named"], bool) for b in blocks])
        self.cells = np.concatenate([space.read(b["cells"]) for b in blocks]).astype(space.exact)
        self.far = np.concatenate([np.frombuffer(b["pivot_dist"], np.float32).reshape(len(space.pivots), -1) for b in blocks], axis=1)
        self.low, self.high = (np.array([b[side] for b in blocks]) for side in ("low", "high"))
        self.starts = np.concatenate(([0], np.cumsum([b["n"] for b in blocks])))

    def best(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows, but own, that score floor at least; ties to smaller ids, those without an id last."""
        space, to = self.space, self.space.distances(query[None, :], query=True)[0]
        reach = np.inf if floor is None else space.reach(query, floor)
        gap = np.maximum(self.low - to, to - self.high).max(1)
        open_blocks = np.flatnonzero(gap <= reach)
        rows = np.concatenate([np.zeros(0, np.int64), *[np.arange(self.starts[b], self.starts[b + 1]) for b in open_blocks]])
        every = len(open_blocks) == len(gap)
        bound, near = np.zeros(len(rows), np.float32), to.astype(np.float32)
        for far, d in zip(self.far, near, strict=True):
            np.maximum(bound, np.abs((far if every else far[rows]) - d), out=bound)
        alive = np.flatnonzero((bound <= reach) & ~((self.ids[rows] == own) & self.named[rows]))
        alive = alive[np.argsort(bound[alive], kind="stable")]
        rows, bound = rows[alive], bound[alive]
        exact, taken, scores = query.astype(space.exact), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(rows), STEP):
            if bound[a] > reach:
                break
            mine = rows[a : a + STEP]
            got = (self.cells[mine] @ exact).astype(np.int64)
            if floor is not None:
                mine, got = mine[got >= floor], got[got >= floor]
            taken, scores = np.concatenate((taken, mine)), np.concatenate((scores, got))
            best = np.lexsort((self.ids[taken], ~self.named[taken], -scores))[:k]
            taken, scores = taken[best], scores[best]
            if len(taken) == k:
                floor = int(scores[-1])
                reach = space.reach(query, floor)
        return taken, scores


def _search(space: Space, k: int):
    """Rows come by task key: first the blocks of a shelf, then queries to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, shelf, key = [], None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                if (r["part"], r["deal"]) != key:
                    blocks, shelf, key = [], None, (r["part"], r["deal"])
                if r["query"] is None:
                    blocks.append(r)
                    continue
                if shelf is None:
                    shelf, blocks = Shelf(space, blocks), []
                rows, scores = shelf.best(space.read(r["query_cells"])[0], r["query_id"], k, r["floor"])
                for column, values in zip(out, ([r["query"]] * len(rows), [r["query_id"]] * len(rows), [int(i) if n else None for i, n in zip(shelf.ids[rows], shelf.named[rows], strict=True)], scores.tolist()), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def _meet(blocks: DataFrame, queries: DataFrame, space: Space, k: int, deals: int, tasks: int) -> DataFrame:
    """Best rows of queries on the shelf that each names; a shelf goes to `deals` tasks, each with a share of the queries."""
    dealt = queries.withColumn("deal", F.pmod(F.xxhash64("query"), F.lit(deals)).cast("int"))
    needed = dealt.select("part", "deal").distinct()
    both = blocks.join(needed, "part").unionByName(dealt, allowMissingColumns=True)
    return both.repartition(tasks, "part", "deal").sortWithinPartitions("part", "deal", F.col("query").isNotNull(), "block").mapInArrow(_search(space, k), FOUND)


def _to_shelves(space: Space, parts: list[int], low: np.ndarray, high: np.ndarray):
    """A row for each query and other shelf whose range leaves room for its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                query = space.read(r["query_cells"])
                to = space.distances(query, query=True)[0]
                reach = np.inf if r["floor"] is None else space.reach(query[0], r["floor"])
                goes = [parts[i] for i in np.flatnonzero(np.maximum(low - to, to - high).max(1) <= reach) if parts[i] != r["part"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(goes), kind) for v, kind in ((r["query"], pa.int64()), (r["query_id"], pa.int64()))]
                    + [pa.array(goes, pa.int64()), pa.array([r["query_cells"]] * len(goes), pa.binary()), pa.array([r["floor"]] * len(goes), pa.int64())],
                    names=[c.split()[0] for c in QUERY.split(", ")])

    return run


def top_by_inner_product(vectors: DataFrame, every: int = EVERY, k: int = TOP, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors(vec_id, embedding) whose vec_id is divisible by `every`, the k rows of highest integer inner product.

    Components become floor(1024 * x). Vectors that are null or hold null, NaN or infinite components take no part; shorter
    vectors count as having zeros behind. Ties go to the smaller vec_id. Rows without a vec_id are candidates only, after all of
    the same score that have one. Rows of one vec_id are each other's own: each is a query by itself, with rows of other ids as candidates; rows that
    repeat are that many candidates of other queries. Other columns are left out. An empty table gives none. Products must fit
    in 64 bits: larger components raise an error.

    Of no shelf more than a task holds is brought together, queries come to it one after the other; only pivots and ranges of
    shelves, a bounded number at a time, are sent to all tasks. Work is all pairs of queries and rows where bounds eliminate
    nothing, as in many dimensions without clusters.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = materialize(whole_cells(vectors))
    sizes = whole.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("whole")), F.lit(0)).alias("dim"), F.coalesce(F.max(F.array_max(F.transform("whole", F.abs))), F.lit(0)).alias("most"),
        F.coalesce(F.max(F.aggregate("whole", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))), F.lit(0.0)).alias("longest"),
    ).first()
    if sizes.most**2 * sizes.dim >= 1 << 63:
        raise ValueError("inner products of these components don't fit in 64 bits")
    dim = max(sizes.dim, 1)
    sample = whole.orderBy(F.xxhash64("vec_id", "whole"), "vec_id").limit(PIVOT_SAMPLE).collect()
    padded = np.array([[*r.whole, *[0] * (dim - len(r.whole))] for r in sample], np.int64).reshape(-1, dim)
    space = Space(dim, sizes.most, sizes.longest, spread_out(padded, pivots) if len(padded) else np.zeros((1, dim)))

    rows = max(1, block_bytes // (8 * dim))
    cores = spark.sparkContext.defaultParallelism
    places = max(1, -(-sizes.n // (rows * SHELF_BLOCKS)), min(2 * cores, sizes.n // rows))
    vectors_at = materialize(whole.mapInArrow(_measured(space), VECTOR).withColumn("salt", F.monotonically_increasing_id()))  # rows that repeat can be parted
    ordered = vectors_at.repartitionByRange(places, "near", "dist", "vec_id", "salt").sortWithinPartitions("near", "dist", "vec_id")
    blocks = materialize(ordered.select("vec_id", "cells", "pivot_dist", F.spark_partition_id().cast("long").alias("place")).mapInArrow(_packed(space, rows), BLOCK))
    queries = materialize(blocks.mapInArrow(_queries(space, every), QUERY))
    deals = max(1, -(-queries.count() // QUERIES_OF_A_TASK))
    tasks = max(deals * places, 1)

    first = materialize(_meet(blocks, queries, space, k, deals, tasks))
    tenth = first.groupBy("query").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") == k)
    asking = materialize(queries.drop("floor").join(tenth, "query", "left").withColumn("floor", F.col("least")).select(*[c.split()[0] for c in QUERY.split(", ")]))
    size = len(space.pivots)
    ranges = blocks.groupBy("part").agg(
        F.array(*[F.min(F.get("low", F.lit(i))) for i in range(size)]).alias("low"), F.array(*[F.max(F.get("high", F.lit(i))) for i in range(size)]).alias("high"))
    found = first
    for share in range(max(1, -(-places * 2 // RANGES))):  # shelves are places, or a few more: about one round for 15,000 shelves
        mine = ranges.where(F.pmod(F.xxhash64("part"), F.lit(max(1, -(-places * 2 // RANGES)))) == share).collect()
        if not mine:
            continue
        low, high = np.array([r.low for r in mine], np.float32), np.array([r.high for r in mine], np.float32)
        others = asking.mapInArrow(_to_shelves(space, [r.part for r in mine], low, high), QUERY)
        found = found.unionByName(materialize(_meet(blocks, materialize(others), space, k, deals, tasks)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; every hundredth id asks."""
    return top_by_inner_product(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP12_SQL = """
with whole as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
    from whole q, whole c where q.vec_id % 100 = 0 and c.vec_id is distinct from q.vec_id
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score
from scored qualify rank <= 10
"""
