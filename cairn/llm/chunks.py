"""A chunk store for corpus-wide exact matching of token windows, and the exchange that decides them.

`documents` become a table of chunks in the shared folder: a few MB of whole texts each, sorted by
doc_id and compressed. A chunk's windows can be recomputed from it at will, in the same order,
so tasks exchange only bare fingerprints and get back bitmaps in the same order:

* `Prints`: a chunk's distinct fingerprints of 64 bits, each with a second hash of 32 bits and the
  smallest doc_id that has it there, dealt by the fingerprint. However often a chunk has one, it
  goes out once. The answer: does a smaller doc_id have it, by both hashes, in some chunk?
* `Groups`: a chunk's distinct groups (anchors) of fingerprints, dealt by the group, with one
  fingerprint and the number of them. A group that very many fingerprints share still sends one
  entry per chunk. The answers: does the group have several fingerprints anywhere, and is it
  hot, so that its members must not be brought together? An anchor is the least hash of a window, so
  its values crowd near 0: a group's label is the anchor's hash mixed anew, and keeps all 64 bits.

The task of a partition keeps fingerprints as sorted immutable runs that are merged by size tiers,
and answers each packed row with bits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize
from .textkit import mix64, text_slices

#: Text bytes in a chunk (one longer text is a chunk alone) and fingerprints in a partition, about.
CHUNK_BYTES, PARTITION_PRINTS = 2 << 20, 400_000
CHUNK_SCHEMA = "batch int, chunk long, n_bytes long, ids binary, known binary, lengths binary, texts binary"
PACKET_SCHEMA = "part int, chunk long, prints binary, labels binary, docs binary, counts binary"
ANSWER_SCHEMA = "chunk long, part int, one binary, two binary"
#: Members from which a group counts as hot.
HOT_MEMBERS = 500
#: Fixed value that sets labels of groups apart from other hashes.
GROUP_SALT = np.uint64(0xA0761D6478BD642F)


def _pack(bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        open_: dict[int, list[tuple[int, bool, bytes]]] = {}
        sizes: dict[int, int] = {}
        nth = TaskContext.get().partitionId() << 32

        def flush(part: int) -> pa.RecordBatch:
            nonlocal nth
            held = sorted(open_.pop(part), key=lambda x: x[:2])
            ids = np.array([x[0] for x in held], np.int64)
            cells = (part, nth, sizes.pop(part), ids.tobytes(), np.array([x[1] for x in held], bool).tobytes(),
                     np.array([len(x[2]) for x in held], np.int64).tobytes(), packer.compress(b"".join(x[2] for x in held)))
            nth += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names(CHUNK_SCHEMA))

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, _, data, offsets in text_slices(batch):
                raw = data.tobytes()
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    doc = ids[at + i]
                    part = bisect_right(bounds, 0 if doc is None else doc)
                    if part in open_ and sizes[part] + b - a > CHUNK_BYTES:
                        yield flush(part)
                    open_.setdefault(part, []).append((0 if doc is None else doc, doc is not None, raw[a:b]))
                    sizes[part] = sizes.get(part, 0) + b - a
        for part in sorted(open_):
            yield flush(part)

    return run


def chunk_table(docs: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """Chunks of docs(doc_id, text), in the shared folder. Null texts are empty; rows of a null doc_id are kept apart.

    Chunks are dealt to batches: documents below bounds[0] to batch 0, those below bounds[1] to batch 1, and so on.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(docs.mapInArrow(_pack(sorted(bounds or [])), CHUNK_SCHEMA))


class Chunk:
    """A chunk's rows: ids, known (doc_id isn't null), offsets, data (UTF-8 bytes)."""

    def __init__(self, row: dict):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(row["lengths"], np.int64))))
        raw = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(self.offsets[-1])))
        self.data = np.frombuffer(raw, np.uint8)


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def packet(part: list, chunk: int, prints: list, labels: list, docs: list, counts: list) -> pa.RecordBatch:
    cells = [pa.array(part, pa.int32()), pa.array([chunk] * len(part), pa.int64()), *(pa.array(c, pa.binary()) for c in (prints, labels, docs, counts))]
    return pa.RecordBatch.from_arrays(cells, names=names(PACKET_SCHEMA))


class Dealt:
    """Entries dealt to partitions by the high bits of a 32-bit hash; bits come back in the same order."""

    def __init__(self, high: np.ndarray, parts: int, base: int):
        part = ((high.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        self.base, self.size = base, len(high)
        self.order = np.argsort(part, kind="stable")
        self.cuts = np.searchsorted(part[self.order], np.arange(parts + 1))

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        for p in np.flatnonzero(np.diff(self.cuts)).tolist():
            yield self.base + p, self.order[self.cuts[p] : self.cuts[p + 1]]

    def spread(self, answers: list[dict], which: str = "one") -> np.ndarray:
        out = np.zeros(self.size, bool)
        for a in answers:
            p = a["part"] - self.base
            if 0 <= p < len(self.cuts) - 1 and a[which] is not None:
                own = self.order[self.cuts[p] : self.cuts[p + 1]]
                out[own] = np.unpackbits(np.frombuffer(a[which], np.uint8), count=len(own)).astype(bool)
        return out


class Prints(Dealt):
    """Distinct fingerprints of a chunk, from occurrences in chunk order.

    prints: fingerprint of each occurrence; row: its row in the chunk; labels: a second 32-bit hash, for
    verification. Occurrences of rows without a doc_id must be left out. again: which occurrences come
    later than another one in this chunk, in a larger doc_id or in the same row.
    """

    def __init__(self, prints: np.ndarray, row: np.ndarray, ids: np.ndarray, parts: int, labels: np.ndarray):
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        head = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, bool)
        self.first = order[head]  # rows are sorted by doc_id: the first occurrence has the smallest
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(head) - 1
        self.prints, self.docs, self.labels = prints[self.first], ids[row[self.first]], labels[self.first]
        place = row[order]
        self.again = np.empty(len(order), bool)
        self.again[order] = ~head & (np.concatenate(([False], place[1:] == place[:-1])) if len(order) else head)
        self.later = ids[row] > self.docs[self.of]
        self.again |= self.later
        super().__init__(self.prints >> np.uint64(32), parts, 0)

    def packets(self, chunk: int) -> Iterator[pa.RecordBatch]:
        cells = [(p, self.prints[own].tobytes(), self.labels[own].tobytes(), pack_ids(self.docs[own])) for p, own in self.slices()]
        if cells:
            part, prints, labels, docs = map(list, zip(*cells, strict=True))
            yield packet(part, chunk, prints, labels, docs, [None] * len(part))


class Groups(Dealt):
    """Distinct groups of a chunk's distinct fingerprints: anchors has the anchor's hash of each fingerprint."""

    def __init__(self, prints: Prints, anchors: np.ndarray, parts: int):
        self.labels, at, self.of, n = np.unique(mix64(anchors ^ GROUP_SALT), return_index=True, return_inverse=True, return_counts=True)
        self.sample, self.counts = prints.prints[at], np.minimum(n, 65535).astype(np.uint16)
        super().__init__(self.labels >> np.uint64(32), parts, parts)

    def packets(self, chunk: int) -> Iterator[pa.RecordBatch]:
        cells = [(p, self.sample[own].tobytes(), self.labels[own].tobytes(), self.counts[own].tobytes()) for p, own in self.slices()]
        if cells:
            part, prints, labels, counts = map(list, zip(*cells, strict=True))
            yield packet(part, chunk, prints, labels, [None] * len(part), counts)


def pack_ids(ids: np.ndarray) -> bytes:
    """The least id, then each id's distance from it in as few bytes as do; ids of a chunk are close together where the corpus is in order."""
    least = ids.min(initial=np.iinfo(np.int64).max)
    far = (ids - least).astype(np.uint64)
    width = np.min_scalar_type(far.max(initial=np.uint64(0)))
    return np.array([least, width.itemsize], np.int64).tobytes() + far.astype(width).tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    least, width = np.frombuffer(raw, np.int64, 2)
    return np.frombuffer(raw, np.dtype(f"u{width}"), offset=16).astype(np.uint64).view(np.int64) + least


class SortedRuns:
    """Log-structured index: sorted immutable runs of (fingerprint, label) -> smallest doc_id, merged by size tiers."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _run(prints, labels, docs):
        if not len(prints):
            return prints, labels, docs
        order = np.argsort(prints)
        prints, labels, docs = prints[order], labels[order], docs[order]
        same = prints[1:] == prints[:-1]
        if (same & (labels[1:] != labels[:-1])).any():  # fingerprints that clash in the first hash alone
            order = np.lexsort((labels, prints))
            prints, labels, docs = prints[order], labels[order], docs[order]
            same &= labels[1:] == labels[:-1]
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        return prints[head], labels[head], np.minimum.reduceat(docs, head)

    def add(self, prints: np.ndarray, labels: np.ndarray, docs: np.ndarray) -> None:
        self.runs.append(self._run(prints, labels, docs))
        while len(self.runs) > 1 and 2 * len(self.runs[-1][0]) > len(self.runs[-2][0]):
            self.runs.append(self._run(*map(np.concatenate, zip(self.runs.pop(), self.runs.pop(), strict=True))))

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.runs) != 1:
            self.runs = [self._run(*map(np.concatenate, zip(*self.runs, strict=True)))]
        return self.runs[0]


def _bits(row: dict, one: np.ndarray, two: np.ndarray | None = None) -> pa.RecordBatch:
    cells = ([row["chunk"]], pa.int64()), ([row["part"]], pa.int32()), ([np.packbits(one).tobytes()], pa.binary()), ([None if two is None else np.packbits(two).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(*c) for c in cells], names=names(ANSWER_SCHEMA))


def answer_prints(packets: list[dict]) -> Iterator[pa.RecordBatch]:
    """one: a smaller doc_id has the fingerprint (and its label) in some chunk."""
    index, pending, size = SortedRuns(), [], 0
    for n, row in enumerate(packets):
        prints = np.frombuffer(row["prints"], np.uint64)
        pending.append((prints, np.frombuffer(row["labels"], np.uint32), unpack_ids(row["docs"])))
        size += len(prints)
        if size > 100_000 or n == len(packets) - 1:
            index.add(*map(np.concatenate, zip(*pending, strict=True)))
            pending, size = [], 0
    prints, labels, docs = index.compact()
    for row in packets:
        own, doc = np.frombuffer(row["prints"], np.uint64), unpack_ids(row["docs"])
        at = np.searchsorted(prints, own)
        label = np.frombuffer(row["labels"], np.uint32)
        while (wrong := labels[at] != label).any():  # the second hash verifies: step over entries that clash in the first alone
            at = at + wrong
        yield _bits(row, doc > docs[at])


def answer_groups(packets: list[dict], hot_members: int) -> Iterator[pa.RecordBatch]:
    """one: the group has several fingerprints over all chunks; two: it is hot."""
    raw = [(np.frombuffer(r["labels"], np.uint64), np.frombuffer(r["prints"], np.uint64), np.frombuffer(r["counts"], np.uint16)) for r in packets]
    labels, prints, counts = map(np.concatenate, zip(*raw, strict=True))
    order = np.lexsort((prints, labels))
    labels, prints, counts = labels[order], prints[order], counts[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
    tail = np.concatenate((head[1:], [len(labels)])) - 1
    several = (prints[head] != prints[tail]) | (np.maximum.reduceat(counts, head) > 1)
    hot = several & (np.add.reduceat(counts, head) > hot_members)
    for row, (own, _, _) in zip(packets, raw, strict=True):
        at = np.searchsorted(labels[head], own)
        yield _bits(row, several[at], hot[at])


def _answers(hot_members: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from answer_prints(held) if held[0]["counts"] is None else answer_groups(held, hot_members)

        for row in rows_of(batches):
            if held and row["part"] != held[0]["part"]:
                yield from flush()
                held = []
            held.append(row)
        yield from flush()

    return run


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def partitions_for(prints: int) -> int:
    return max(16, -(-prints // PARTITION_PRINTS))


def second_hash(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """32 bits that also depend on another hash: with the fingerprint itself, 96 bits have to agree."""
    return (mix64(one * np.uint64(0xD6E8FEB86659FD93) ^ other) >> np.uint64(32)).astype(np.uint32)


def exchange(sent: DataFrame, parts: int, hot_members: int = HOT_MEMBERS) -> DataFrame:
    """Answers to the packets of `sent`: one row per chunk with all its (part, one, two)."""
    answered = sent.repartition(2 * parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(_answers(hot_members), ANSWER_SCHEMA)
    return answered.groupBy("chunk").agg(F.collect_list(F.struct("part", "one", "two")).alias("answers"))


def per_chunk(work: Callable[[dict], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield from work(row)

    return run
