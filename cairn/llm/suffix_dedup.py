"""Exact removal of repeated 100-byte strings over the whole corpus, with run-length BWT indexes.

1. All 100-byte windows are cut into runs that share their anchor (textkit.anchored_windows), so
   equal windows meet under one anchor. An exchange of (anchor, hashes of the run's bytes) per
   chunk collapses whole copies of a run, 96 bits of hash agreeing, onto the first of them; and it
   tells which anchors have different runs. A run whose anchor has no other bytes is unique.
2. Different runs of one anchor, the edges of repeats, go to one bounded shard per set of anchors.
   A shard's texts are indexed by a run-length compressed Burrows-Wheeler transform: runs of
   equal symbols, where each run's head maps to, and the match length sampled there. Neither the
   suffix array nor ranks of single symbols are kept. The texts are then streamed against the index
   from their ends, all in step: the last-to-first mapping moves on symbol by symbol, and the matching
   statistic is the one before plus one inside a run of the transform, the sample at a head. Places
   whose match is long enough fall into classes of equal strings, of which all but the first go.
   An anchor that very many different runs share is hot and isn't brought together: the single
   windows of its runs are exchanged by 96 bits of hash instead, once per chunk.
3. Marks and texts meet once more per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import HOT_MEMBERS, PACKET_SCHEMA, Chunk, Groups, Prints, answer_prints, chunk_table, exchange, names, pack_ids, partitions_for, per_chunk, second_hash
from .shared import table
from .textkit import BYTE_VALUES, Ranges, anchored_windows, cover, text_slices

LENGTH, ANCHOR = 100, 40
#: Bytes of edge runs in a shard with an index of its own, at least one anchor: sorting is quickest within the cache.
INDEX_BYTES = 1 << 17
#: Rows to compare: edge runs by anchor (place: where the anchor is in the bytes); packets of windows of hot anchors,
#: whose key is -1 - part; and marks that are settled already, whose key is below -2**40.
EDGE_SCHEMA = "key long, doc_id long, chunk long, start long, bytes binary, row long, place long, prints binary, labels binary, docs binary, starts binary"
MARK_SCHEMA, SETTLED = "chunk long, starts binary", -(1 << 40)
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- the run-length index -------------------------------------------------------------------


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling of what isn't told apart yet.

    left: symbols up to and with the 0 that ends the text of a position. Each 0 is a symbol of its
    own, less than those after it, so suffixes differ at their ends at the latest.
    """
    n, span = len(text), 6
    pad = np.concatenate((text.astype(np.uint64), np.zeros(span, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(span):  # symbols behind the end don't count
        key = (key << np.uint64(9)) | np.where(left > j, pad[j : n + j], np.uint64(0))
    order = np.argsort(key, kind="stable")
    slots, same = np.arange(n), key[order][1:] == key[order][:-1]
    rank = np.empty(n, np.int64)
    while True:
        # in slots, order has groups of equal keys; a group whose suffixes have ended is in order, as sorting is stable
        own = order[slots]
        same &= left[own[1:]] > span
        head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), slots, 0))
        rank[own] = head
        open_ = np.concatenate((same, [False])) | np.concatenate(([False], same))
        slots = slots[open_]
        if not len(slots):
            return order
        own = np.sort(order[slots])
        key = rank[own] * n + rank[own + span]
        turn = np.argsort(key, kind="stable")
        order[slots] = own[turn]
        same = key[turn][1:] == key[turn][:-1]
        span *= 2


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b share; 0 ends a text and equals nothing."""
    known, live = np.zeros(len(a), np.int64), np.arange(len(a))
    while len(live):
        x = text[a[live] + known[live]]
        live = live[(x == text[b[live] + known[live]]) & (x > 0)]
        known[live] += 1
    return known


class RunLengthIndex:
    """Run-length BWT of texts. Kept per BWT run only: heads, where it begins; images, where its head's
    suffix goes when the run's symbol is put before it; sampled, the match length there."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        sizes = np.diff(np.concatenate(([0], ends)))
        self.sizes = sizes
        begin = ends - sizes + np.arange(len(sizes))
        text = np.zeros(len(data) + len(sizes), np.uint16)  # a 0 ends each text
        text[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data.astype(np.uint16) + 1
        left = np.repeat(begin + sizes + 1, sizes + 1) - np.arange(len(text))
        order = suffix_array(text, left)
        bwt = text[order - 1]
        self.heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        symbol, length = bwt[self.heads], np.diff(np.concatenate((self.heads, [len(bwt)])))
        by_symbol = np.argsort(symbol, kind="stable")  # runs of a symbol map, in their order, to the suffixes that begin with it
        self.images = np.empty(len(symbol), np.int64)
        self.images[by_symbol] = np.cumsum(length[by_symbol]) - length[by_symbol]
        at = np.flatnonzero(symbol > 0)
        self.sampled = np.zeros(len(symbol), np.int64)
        self.sampled[at] = shared_prefix(text, order[self.images[at]], order[self.images[at] - 1])

    def stream(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Stream the texts from their ends: (texts, starts, places in suffix order, matching statistics) step by step,
        for starts with at least `length` symbols behind them. The statistic is how much the suffix shares with the one before it in order."""
        texts = np.argsort(-self.sizes, kind="stable")
        place, match = texts.copy(), np.zeros(len(texts), np.int64)  # ends are the first in order, text by text
        done = np.searchsorted(-self.sizes[texts], -np.arange(1, int(self.sizes.max(initial=0)) + 1), side="right")
        for step, live in enumerate(done.tolist(), 1):
            texts, place, match = texts[:live], place[:live], match[:live]
            run = np.searchsorted(self.heads, place, side="right") - 1
            inside = place - self.heads[run]
            match = np.where(inside > 0, match + 1, self.sampled[run])
            place = self.images[run] + inside
            if step >= length:
                yield texts, self.sizes[texts] - step, place, match


def earlier_windows(data: np.ndarray, ends: np.ndarray, docs: np.ndarray, rows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the windows that also start in a smaller doc_id, or earlier in the same row.

    Texts are runs by doc_id, row and start; rows tells rows apart that repeat a doc_id.
    """
    text, start, place, match = map(np.concatenate, zip(*RunLengthIndex(data, ends).stream(length), strict=True))
    order = np.argsort(place)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(match[order] < length)
    order = np.lexsort((start, text, group))
    group, text, start = group[order], text[order], start[order]
    same = np.concatenate(([False], group[1:] == group[:-1]))
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    later = docs[text] > docs[text[first]]
    later[1:] |= same[1:] & (rows[text[1:]] == rows[text[:-1]])
    return text[later], start[later]


def related_runs(data: np.ndarray, ends: np.ndarray, places: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Which runs may share a window with another one.

    A shared window has length - anchor bytes beside the anchor, so at least half of them on one side:
    both runs then agree on the anchor with that half to its left, or with that half to its right.
    """
    begin, half = np.concatenate(([0], ends[:-1])), (length - anchor + 1) // 2
    at = begin + places
    ranges = Ranges(data, BYTE_VALUES)
    keep = np.zeros(len(ends), bool)
    for a, b in ((at - half, at + anchor), (at, at + anchor + half)):
        own = np.flatnonzero((a >= begin) & (b <= ends))
        _, same, n = np.unique(ranges.hash(a[own], b[own]), return_inverse=True, return_counts=True)
        keep[own[n[same] > 1]] = True
    return keep


# --- Spark steps ------------------------------------------------------------------------------


class Cut:
    """A chunk's runs of windows: row, start, count, anchor; and what the exchange says of them."""

    def __init__(self, row: dict, parts: int, length: int):
        self.chunk, self.length = Chunk(row), length
        at, start, count, anchor, whole, place = anchored_windows(self.chunk.data, self.chunk.offsets, length, ANCHOR, BYTE_VALUES)
        ok = self.chunk.known[at]
        self.row, self.start, self.count, self.anchor, self.place, whole = at[ok], start[ok], count[ok], anchor[ok], (place - start)[ok], whole[ok]
        self.prints = Prints(whole, self.row, self.chunk.ids, parts, second_hash(whole, self.anchor))
        self.groups = Groups(self.prints, self.anchor[self.prints.first], parts)

    def decide(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(removed whole, edges to compare, edges of hot anchors)."""
        removed = self.prints.spread(answers)[self.prints.of] | self.prints.again
        of = self.groups.of[self.prints.of]
        open_, hot = ~removed & self.groups.spread(answers)[of], self.groups.spread(answers, "two")[of]
        return removed, open_ & ~hot, open_ & hot

    def windows(self, runs: np.ndarray) -> np.ndarray:
        n = self.count[runs]
        return np.repeat(self.start[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def hot_windows(self, hot: np.ndarray, parts: int) -> tuple[Prints, np.ndarray]:
        """Windows of hot runs: their prints, with a label that also depends on the anchor; and their starts."""
        start, row = self.windows(hot), np.repeat(self.row[hot], self.count[hot])
        one = Ranges(self.chunk.data, BYTE_VALUES).hash(start, start + self.length) if len(start) else np.zeros(0, np.uint64)
        return Prints(one, row, self.chunk.ids, parts, second_hash(one, np.repeat(self.anchor[hot], self.count[hot]))), start


def _send(parts: int, length: int):
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        cut = Cut(row, parts, length)
        yield from cut.prints.packets(row["chunk"])
        yield from cut.groups.packets(row["chunk"])

    return per_chunk(work)


def _edge_rows(n: int, **columns) -> pa.RecordBatch:
    kinds = [pa.binary() if f.endswith("binary") else pa.int64() for f in EDGE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names(EDGE_SCHEMA), kinds, strict=True)], names=names(EDGE_SCHEMA))


def _edges(parts: int, hot_parts: int, length: int):
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        cut = Cut(row, parts, length)
        chunk, number = cut.chunk, row["chunk"]
        removed, edge, hot = cut.decide(row["answers"] or [])
        at = np.flatnonzero(edge)
        for a in range(0, len(at), 4000):
            own = at[a : a + 4000]
            raw = [chunk.data[s : s + n + length - 1].tobytes() for s, n in zip(cut.start[own].tolist(), cut.count[own].tolist(), strict=True)]
            yield _edge_rows(
                len(own), key=pa.array((cut.anchor[own] >> np.uint64(1)).view(np.int64)), doc_id=pa.array(chunk.ids[cut.row[own]]), chunk=pa.array(np.full(len(own), number)),
                start=pa.array(cut.start[own].astype(np.int64)), bytes=pa.array(raw, pa.binary()), row=pa.array(cut.row[own].astype(np.int64)), place=pa.array(cut.place[own].astype(np.int64)))
        prints, start = cut.hot_windows(hot, hot_parts)
        for part, own in prints.slices():
            # an entry stands for its first occurrence; rows that repeat that one's doc_id share its answer
            mine = np.flatnonzero(~prints.again & np.isin(prints.of, own))
            entry = prints.of[mine]
            yield _edge_rows(
                1, key=pa.array([-1 - part]), chunk=pa.array([number]), prints=pa.array([prints.prints[entry].tobytes()], pa.binary()), labels=pa.array([prints.labels[entry].tobytes()], pa.binary()),
                docs=pa.array([pack_ids(prints.docs[entry])], pa.binary()), starts=pa.array([start[mine].astype(np.int64).tobytes()], pa.binary()))
        marks = np.concatenate((cut.windows(removed), start[prints.again]))
        if len(marks):
            yield _edge_rows(1, key=pa.array([SETTLED - number]), chunk=pa.array([number]), starts=pa.array([pack_marks(marks)], pa.binary()))

    return per_chunk(work)


def pack_marks(starts: np.ndarray) -> bytes:
    """Sorted window starts as runs: (start, length) pairs of 32 bits."""
    starts = np.unique(starts)
    head = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1] + 1)))
    return np.column_stack((starts[head], np.diff(np.concatenate((head, [len(starts)]))))).astype(np.uint32).tobytes()


def unpack_marks(raw: bytes) -> np.ndarray:
    pairs = np.frombuffer(raw, np.uint32).reshape(-1, 2).astype(np.int64)
    n = pairs[:, 1]
    return np.repeat(pairs[:, 0] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _marks(chunk: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(chunk, kind="stable")
    chunks, head = np.unique(chunk[order], return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(chunks), pa.array([pack_marks(x) for x in np.split(starts[order], head[1:])], pa.binary())], names=names(MARK_SCHEMA))


def _answer_windows(packets: list[dict]) -> Iterator[pa.RecordBatch]:
    """Marks of hot anchors' windows, from one part's packets."""
    for row, batch in zip(packets, answer_prints(packets), strict=True):
        starts = np.frombuffer(row["starts"], np.int64)
        bits = np.unpackbits(np.frombuffer(batch.column("one")[0].as_py(), np.uint8), count=len(starts)).astype(bool)
        if bits.any():
            yield _marks(np.full(int(bits.sum()), row["chunk"]), starts[bits])


def _compare_edges(edges: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Marks of whole anchors' edge runs, through an index of their own."""
    _, _, data, offsets = next(text_slices(edges, "bytes", 1 << 62))
    keep = np.flatnonzero(related_runs(data, offsets[1:], edges.column("place").to_numpy(), length))
    if not len(keep):
        return
    doc, chunk, start, row = (edges.column(c).to_numpy()[keep] for c in ("doc_id", "chunk", "start", "row"))
    order = np.lexsort((start, row, chunk, doc))  # a shard's texts in the order of the corpus, across anchors
    doc, chunk, start, row, own = doc[order], chunk[order], start[order], row[order], keep[order]
    rows = np.cumsum(np.concatenate(([True], (chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1]))))
    sizes = np.diff(offsets)[own]
    ends = np.cumsum(sizes)
    data = data[np.repeat(offsets[:-1][own] - (ends - sizes), sizes) + np.arange(sizes.sum())]
    text, offset = earlier_windows(data, ends, doc, rows, length)
    if len(text):
        yield _marks(chunk[text], start[text] + offset)


def _compare(length: int):
    """Rows come sorted by key: settled marks, then packets part by part, then edge runs, of which whole anchors are gathered up to INDEX_BYTES for one index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets: list[dict] = []
        edges: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            settled, packed = np.searchsorted(keys, SETTLED, side="right"), np.searchsorted(keys, 0)
            if settled:
                yield batch.slice(0, settled).select(names(MARK_SCHEMA))
            for row in batch.slice(settled, packed - settled).select(["key", "chunk", "prints", "labels", "docs", "starts"]).to_pylist():
                if packets and row["key"] != packets[-1]["key"]:
                    yield from _answer_windows(packets)
                    packets = []
                packets.append(row | {"part": -1 - row["key"]})
            if packed < len(keys):
                batch, keys = batch.slice(packed), keys[packed:]
                ends = np.cumsum(np.diff(next(text_slices(batch, "bytes", 1 << 62))[3]))
                at = 0
                for change in np.flatnonzero(np.diff(keys, prepend=edges[-1].column("key")[-1].as_py() if edges else keys[0])).tolist():
                    # an anchor ends here
                    if size + (int(ends[change - 1]) if change else 0) - (int(ends[at - 1]) if at else 0) >= INDEX_BYTES:
                        yield from _compare_edges(_joined([*edges, batch.slice(at, change - at)]), length)
                        edges, size, at = [], 0, change
                if at < len(keys):
                    edges.append(batch.slice(at))
                    size += int(ends[-1]) - (int(ends[at - 1]) if at else 0)
        if packets:
            yield from _answer_windows(packets)
        if edges:
            yield from _compare_edges(_joined(edges), length)

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _result(length: int):
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(row)
        marks = np.zeros(len(chunk.data), bool)
        for x in row["marks"] or []:
            marks[unpack_marks(x)] = True
        gone = cover(marks, length)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[chunk.offsets[:-1][chunk.offsets[:-1] < len(gone)]] |= gone[chunk.offsets[:-1][chunk.offsets[:-1] < len(gone)]]
        out: list[list] = [[], [], [], [], []]
        for i, (a, b) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)):
            cells = (int(chunk.ids[i]) if chunk.known[i] else None, b - a, int(gone[a:b].sum()), int(opens[a:b].sum()), hashlib.sha256(chunk.data[a:b][~gone[a:b]].tobytes()).hexdigest())
            for o, c in zip(out, cells, strict=True):
                o.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(o, pa.int64()) for o in out[1:4]), pa.array(out[4], pa.string())], names=names(RESULT_SCHEMA))

    return per_chunk(work)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_members: int = HOT_MEMBERS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs(doc_id, text, ...).

    Each byte covered by a `length`-byte string that also starts earlier (smaller doc_id, or same
    document, earlier start) is removed; strings are judged on the input. Null texts are empty.
    Rows of a null doc_id have no place in the order: nothing is removed from them or for them.
    Rows that repeat a doc_id are documents of their own, neither earlier than the other. Other
    columns are ignored, so their names can't clash. A text beyond a chunk's size is a chunk alone and is
    hashed in blocks. An empty table gives an empty result.
    """
    chunks = chunk_table(docs)
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts, hot_parts = partitions_for(total // 28), partitions_for(total // 10)  # windows of one anchor are about 30
    answers = exchange(chunks.mapInArrow(_send(parts, length), PACKET_SCHEMA), parts, hot_members)
    answered = chunks.join(answers, "chunk", "left")
    spread = max(8, total // (16 << 20))
    edges = answered.mapInArrow(_edges(parts, hot_parts, length), EDGE_SCHEMA).repartition(spread, "key").sortWithinPartitions("key", "doc_id", "chunk", "start")
    marks = edges.mapInArrow(_compare(length), MARK_SCHEMA).groupBy("chunk").agg(F.collect_list("starts").alias("marks"))
    return chunks.join(marks, "chunk", "left").mapInArrow(_result(length), RESULT_SCHEMA)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier (see remove_repeats)."""
    return remove_repeats(table(spark, sf_dir, "documents"))
