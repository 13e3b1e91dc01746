"""Log-structured fingerprint indexes as tables, extended batch by batch.

An index is a list of runs: immutable tables of fingerprints in sorted order, one sorted array for each hash
partition. A new batch is merge-joined with all runs, found fingerprints are verified by a second hash, and
those that are new to the index make the next run. Once there are more than `fanout` runs they are compacted into one.

* `SortedRuns` takes a chunk store's packets (chunks.py), packed by hash partition: the index of op10.
* `FingerprintIndex` takes documents and has each window's fingerprint as a row, for corpora that grow for good.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import SortedRuns as Merging
from .chunks import names, rows_of, unpack_ids
from .shared import bounded_batches, materialize
from .textkit import Ranges, Words, cover, mix64, text_slices

LENGTH, RESULT_SCHEMA = 13, "doc_id long, n_words long, n_removed long, kept_sha256 string"
WINDOW_SCHEMA = "doc_id long, th long, at int, print long, check long"
RUN_KEYS = ["print", "check"]
#: Answers to a batch's packets, and the partition's next run (chunk is null).
JOINED_SCHEMA = "chunk long, part int, one binary, prints binary, labels binary"


def _joined(row_chunk, part: int, one, prints, labels) -> pa.RecordBatch:
    cells = (([row_chunk], pa.int64()), ([part], pa.int32()), ([one], pa.binary()), ([prints], pa.binary()), ([labels], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(*c) for c in cells], names=names(JOINED_SCHEMA))


def _known(prints: np.ndarray, labels: np.ndarray, own: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Where sorted (prints, labels) have an entry: a merge join on the first hash, verified by the second."""
    at, found = np.searchsorted(prints, own), np.zeros(len(own), bool)
    live = np.flatnonzero(at < len(prints))
    while len(live):
        live = live[prints[at[live]] == own[live]]
        found[live] |= labels[at[live]] == label[live]
        live = live[~found[live]]  # clashes in the first hash alone: the next entry
        at[live] += 1
        live = live[at[live] < len(prints)]
    return found


def _merge_join(compact: bool):
    """Rows come by part: its runs first (chunk below 0), then the batch's packets."""

    def flush(part: int, runs: list[tuple], packets: list[tuple]) -> Iterator[pa.RecordBatch]:
        merging = Merging()
        for prints, labels, docs, _ in packets:
            merging.add(prints, labels, docs)
        prints, labels, docs = merging.compact() if packets else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        old = np.zeros(len(prints), bool)
        for run in runs:
            old |= _known(*run, prints, labels)
        for own, label, doc, chunk in packets:
            at = np.searchsorted(prints, own)
            while (wrong := labels[at] != label).any():
                at = at + wrong
            yield _joined(chunk, part, np.packbits(old[at] | (doc > docs[at])).tobytes(), None, None)
        prints, labels = prints[~old], labels[~old]
        if compact:
            merging = Merging()
            merging.runs = [(p, x, np.zeros(len(p), np.int64)) for p, x in [*runs, (prints, labels)]]
            prints, labels, _ = merging.compact()
        if len(prints):
            yield _joined(None, part, None, prints.tobytes(), labels.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs, packets = None, [], []
        for row in rows_of(batches):
            if row["part"] != part:
                if part is not None:
                    yield from flush(part, runs, packets)
                part, runs, packets = row["part"], [], []
            prints, labels = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["labels"], np.uint32)
            if row["chunk"] < 0:
                runs.append((prints, labels))
            else:
                packets.append((prints, labels, unpack_ids(row["docs"]), row["chunk"]))
        if part is not None:
            yield from flush(part, runs, packets)

    return run


class SortedRuns:
    """Fingerprints of a chunk store's batches. Batches must come in the order of their documents: what the index has is from smaller doc_ids.

    runs are the index's tables; a partition's new run leaves out what older ones have. `fanout` bounds their number.
    """

    def __init__(self, parts: int, fanout: int = 4, runs: list[DataFrame] | None = None):
        self.parts, self.fanout, self.runs = parts, fanout, list(runs or [])

    def extend(self, sent: DataFrame) -> DataFrame:
        """(chunk, answers) to the packets `sent`: whether a smaller doc_id has a fingerprint, in the index or in the batch itself. The batch then belongs to the index."""
        every, compact = sent, len(self.runs) >= self.fanout
        for i, r in enumerate(self.runs):
            every = every.unionByName(r.select("part", F.lit(-1 - i).cast("long").alias("chunk"), "prints", "labels"), allowMissingColumns=True)
        joined = materialize(every.repartition(self.parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(_merge_join(compact), JOINED_SCHEMA))
        self.runs = [*([] if compact else self.runs), joined.where("chunk is null").select("part", "prints", "labels")]
        return joined.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("part", "one", F.lit(None).cast("binary").alias("two"))).alias("answers"))


def _windows(length: int):
    """A row for each window of a document: its place among the words and two 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("doc_id"), batch.column("th")
            for first, _, data, offsets in text_slices(batch):
                words = Words(data, offsets)
                n = np.maximum(words.counts() - length + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = words.ptr[:-1][row] + at
                one, two = (Ranges(h).hash(start, start + length) for h in (words.hash, mix64(words.hash)))
                take = pa.array(first + row)
                yield pa.RecordBatch.from_arrays([ids.take(take), th.take(take), pa.array(at.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=names(WINDOW_SCHEMA))

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                words = (r["text"] or "").encode().split()
                marks = np.zeros(len(words), bool)
                marks[np.array(r["starts"] or [], np.int64)] = True
                gone = cover(marks, length)
                kept = b" ".join(compress(words, (~gone).tolist()))
                for o, c in zip(out, (r["doc_id"], len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()), strict=True):
                    o.append(c)
            yield pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], names=names(RESULT_SCHEMA))

    return run


class FingerprintIndex:
    """runs are the paths of the index's tables; pass them on to open the index again."""

    def __init__(self, spark: SparkSession, folder: str, runs: list[str] | None = None, length: int = LENGTH, fanout: int = 4):
        self.spark, self.folder, self.runs, self.length, self.fanout = spark, folder.rstrip("/"), list(runs or []), length, fanout

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run-{uuid.uuid4().hex}"
        rows.sortWithinPartitions(*RUN_KEYS).write.parquet(path)
        return path

    def compact(self) -> None:
        if len(self.runs) > 1:
            every = self.spark.read.parquet(*self.runs)
            self.runs = [self._write(every.groupBy(*RUN_KEYS).agg(F.min("doc").alias("doc")))]

    def extend(self, batch: DataFrame) -> DataFrame:
        """(doc_id, n_words, n_removed, kept_sha256) of the batch's rows; the batch then belongs to history.

        Null texts have no words; rows of a null doc_id neither lose words nor enter the index.
        """
        bounded_batches(self.spark)
        docs = batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
        windows = materialize(docs.where("doc_id is not null and text is not null").mapInArrow(_windows(self.length), WINDOW_SCHEMA))
        mine = windows.groupBy(*RUN_KEYS).agg(F.min("doc_id").alias("doc"))
        if self.runs:
            history = self.spark.read.parquet(*self.runs)
            known = materialize(mine.unionByName(history.join(mine.select(*RUN_KEYS), RUN_KEYS, "left_semi")).groupBy(*RUN_KEYS).agg(F.min("doc").alias("doc")))
            fresh = mine.join(history.select(*RUN_KEYS, F.col("doc").alias("old")), RUN_KEYS, "left").where(F.col("old").isNull() | (F.col("doc") < F.col("old"))).drop("old")
        else:
            known = fresh = materialize(mine)
        marks = materialize(windows.join(known, RUN_KEYS).where("doc < doc_id").groupBy("doc_id", "th").agg(F.collect_set("at").alias("starts")))
        self.runs.append(self._write(fresh))
        if len(self.runs) > self.fanout:
            self.compact()
        return docs.join(marks, ["doc_id", "th"], "left").select("doc_id", "text", "starts").mapInArrow(_cut(self.length), RESULT_SCHEMA)
