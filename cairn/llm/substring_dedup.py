"""Removal of 13-word windows that a smaller doc_id has as well, by log-structured fingerprint indexes.

The chunk store (chunks.py) holds the texts, in batches by doc_id. A pass over it tells which anchors have
different words around them anywhere: the edges of repeats. Then the batches go, in the order of their
documents, through two indexes of sorted immutable runs (fingerprint_index.SortedRuns). A batch is
merge-joined with the runs of those before it, hits are verified by a second hash, and what is
new becomes the next run; runs are compacted once there are several.

The first index has one fingerprint for each run of windows with the same anchor, about six windows;
it settles exact repeats and unique text. The second has the single windows of what is left
at the edges of repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import PACKET_SCHEMA, Chunk, Groups, Prints, chunk_table, exchange, partitions_for, per_chunk, second_hash
from .fingerprint_index import LENGTH, RESULT_SCHEMA, SortedRuns
from .shared import materialize, table
from .textkit import Ranges, Words, anchored_windows, cover, mix64

ANCHOR = 5
#: Batches that a corpus is dealt to.
BATCHES = 2


class Runs:
    """The anchored runs of a chunk's words, and what the first round says of them."""

    def __init__(self, row: dict, parts: int, length: int):
        self.chunk = Chunk(row)
        self.words = Words(self.chunk.data, self.chunk.offsets)
        at, start, count, anchor, whole, _ = anchored_windows(self.words.hash, self.words.ptr, length, ANCHOR)
        ok = self.chunk.known[at]
        self.row, self.start, self.count, anchor, whole = at[ok], start[ok], count[ok], anchor[ok], whole[ok]
        self.prints = Prints(whole, self.row, self.chunk.ids, parts, second_hash(whole, anchor))
        self.groups = Groups(self.prints, anchor[self.prints.first], parts)
        self.length = length

    @staticmethod
    def repeats(prints: Prints, answers: list[dict]) -> np.ndarray:
        """Which occurrences a smaller doc_id has as well."""
        return prints.spread(answers)[prints.of] | prints.later

    def edges(self, answers: list[dict], contested: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(runs that a smaller doc_id has whole, other runs whose anchor has different words around it somewhere)."""
        removed = self.repeats(self.prints, answers)
        return removed, ~removed & self.groups.spread(contested)[self.groups.of][self.prints.of]

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, row) of the windows of the marked runs."""
        n = self.count[runs]
        return np.repeat(self.start[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(self.row[runs], n)

    def edge_prints(self, edges: np.ndarray, parts: int) -> tuple[Prints, np.ndarray]:
        start, row = self.windows(edges)
        one, two = (Ranges(h).hash(start, start + self.length) for h in (self.words.hash, mix64(self.words.hash)))
        return Prints(one, row, self.chunk.ids, parts, (two >> np.uint64(32)).astype(np.uint32)), start


def _send(kind: str, parts: int, edge_parts: int, length: int):
    """Packets of a chunk: its groups, its runs, or the windows of its edges."""

    def work(row: dict) -> Iterator[pa.RecordBatch]:
        runs = Runs(row, parts, length)
        if kind == "windows":
            yield from runs.edge_prints(runs.edges(row["answers"] or [], row["contested"] or [])[1], edge_parts)[0].packets(row["chunk"])
        else:
            yield from (runs.groups if kind == "groups" else runs.prints).packets(row["chunk"])

    return per_chunk(work)


def _result(parts: int, edge_parts: int, length: int):
    def work(row: dict) -> Iterator[pa.RecordBatch]:
        runs = Runs(row, parts, length)
        removed, edges = runs.edges(row["answers"] or [], row["contested"] or [])
        marks = np.zeros(len(runs.words.hash), bool)
        marks[runs.windows(removed)[0]] = True
        prints, start = runs.edge_prints(edges, edge_parts)
        marks[start[runs.repeats(prints, row["found"] or [])]] = True
        gone = cover(marks, length)
        chunk, out = runs.chunk, ([], [], [], [])
        raw = chunk.data.tobytes()
        for i, (a, b) in enumerate(zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True)):
            words, own = raw[a:b].split(), gone[runs.words.ptr[i] : runs.words.ptr[i + 1]]
            n = int(own.sum())
            kept = compress(words, (~own).tolist()) if n else words
            for o, c in zip(out, (int(chunk.ids[i]) if chunk.known[i] else None, len(words), n, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                o.append(c)
        yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], names=[f.split()[0] for f in RESULT_SCHEMA.split(", ")])

    return per_chunk(work)


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that cut the corpus into batches of about equal numbers of rows."""
    if batches < 2:
        return []
    found = docs.select(F.col("doc_id").cast("double").alias("id")).where("id is not null").approxQuantile("id", [i / batches for i in range(1, batches)], 0.02)
    return sorted({int(x) for x in found})


def remove_known_windows(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs(doc_id, text, ...).

    Each word covered by a window of `length` words that also starts in a smaller doc_id is
    removed; windows are judged on the input and never cross documents. Words are
    `[^\\x20\\x09-\\x0D]+`, unchanged. Null texts have no words. Rows of a null doc_id have no place
    in the order: nothing is removed from them or for them. Rows that repeat a doc_id are equally
    early. Other columns are ignored, so their names can't clash. A text beyond a chunk's size is a chunk alone and is
    hashed in blocks. An empty table gives an empty result.
    """
    bounds = batch_bounds(docs, batches)
    chunks = chunk_table(docs, bounds)
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts, edge_parts = partitions_for(total // 30), partitions_for(total // 60)  # a run per 30 bytes or so
    send = lambda rows, kind: rows.mapInArrow(_send(kind, parts, edge_parts, length), PACKET_SCHEMA)
    contested = materialize(exchange(send(chunks, "groups"), parts).withColumnRenamed("answers", "contested"))
    whole, single, out = SortedRuns(parts), SortedRuns(edge_parts), None
    for i in range(len(bounds) + 1):
        batch = chunks.where(F.col("batch") == i)
        settled = batch.join(whole.extend(send(batch, "runs")), "chunk", "left").join(contested, "chunk", "left")
        found = single.extend(send(settled, "windows")).withColumnRenamed("answers", "found")
        done = settled.join(found, "chunk", "left").mapInArrow(_result(parts, edge_parts, length), RESULT_SCHEMA)
        out = done if out is None else out.unionByName(done)
    return out


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows of smaller doc_ids (see remove_known_windows)."""
    return remove_known_windows(table(spark, sf_dir, "documents"))
