"""Quality rules: base counts, and compression bands that reject repetitive or incompressible text.

The verdict compares zstandard ratios (bytes / compressed bytes) with limits that depend on
length: of the whole document, and of fixed chunks of it, the tail as a document of its own length. A
ratio above the upper limit means repetition, of the whole text or, if much of it is in such chunks, of parts; below the lower
limit, noise such as encoded data. Scripts of several bytes a character compress more in long texts and less in short ones, so
upper limits grow with the root of the bytes a code point, and text that isn't mostly ASCII has lower limits of its own.
Encoded noise is ASCII. Where its alphabet is small (hex) it compresses as well as prose; so chunks that are mostly ASCII are also
judged by how often pairs of bytes recur: in prose more often than the frequencies of single bytes explain, in noise not.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import aside, bounded_batches, fresh, table
from .textkit import Ranges, Words, cover, text_slices

#: Limits from a length in bytes on: (length, largest ratio). Prose sits well inside.
DOCUMENT_MOST = [(0, 3.0), (400, 3.2), (800, 3.4), (1600, 3.6), (3200, 3.8), (6400, 4.2), (25600, 5.0)]
#: Least ratio by length in bytes, linear in between. Prose of sf0.1 has at least 1.10 from 150 bytes on, 1.19 at 256, 1.40 at 512,
#: 1.66 at 1024, 1.88 at 2048, 2.13 at 6400; base64 has 1.07, 1.19, 1.25, 1.29 at 256 to 2048. Below 160 bytes the frame's overhead hides both.
LEAST_AT, LEAST = (0, 159, 160, 256, 512, 1024, 1536, 2048, 6400, 25600), (0.0, 0.0, 1.0, 1.12, 1.28, 1.45, 1.55, 1.6, 1.75, 1.9)
#: The same for text of which less than ASCII_SHARE of the bytes are ASCII: Chinese prose has 1.08 at 256 bytes, 1.20 at 512, 1.28 at 762; Russian, Greek,
#: Hindi and Japanese have more.
OTHER_AT, OTHER_LEAST, ASCII_SHARE = (0, 255, 256, 512, 1024, 2048), (0.0, 0.0, 1.0, 1.08, 1.15, 1.2), 0.8
#: Chunks of CHUNK bytes; a document fails if more than CHUNK_SHARE of its bytes are in chunks above CHUNK_MOST (the tail: above the limit of a
#: document of its length), or more than NOISE_SHARE in chunks that are noise.
CHUNK, CHUNK_MOST, CHUNK_SHARE, NOISE_SHARE, LEVEL = 2048, 3.8, 0.25, 0.05, 3
#: Chunks from PAIRS_FROM bytes on that are mostly ASCII are noise if pairs recur less than PAIR_GAIN times as often as by chance: prose of sf0.1 has at
#: least 1.49, hex at most 1.17.
PAIRS_FROM, PAIR_GAIN = 512, 1.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"


def pair_gain(raw: bytes) -> float:
    """How many times as often two places have the same pair of bytes as they would if bytes were drawn one by one."""
    one = np.frombuffer(raw, np.uint8)
    two = np.sort(one[:-1].astype(np.uint16) << 8 | one[1:])
    runs = np.diff(np.flatnonzero(np.concatenate(([True], two[1:] != two[:-1], [True]))))
    single = np.bincount(one, minlength=256)
    chance = (single * (single - 1)).sum() / (len(one) * (len(one) - 1))
    return (runs * (runs - 1)).sum() / (len(two) * (len(two) - 1)) / chance**2 if chance else 0.0


def _limits(raw: bytes, most: float) -> tuple[bool, float, float]:
    """(mostly ASCII, least ratio, largest ratio) of a text or chunk; most: the largest at one byte a code point."""
    cells = np.frombuffer(raw, np.uint8)
    ascii_only = bool((cells < 0x80).sum() >= ASCII_SHARE * len(cells))
    least = np.interp(len(raw), LEAST_AT, LEAST) if ascii_only else np.interp(len(raw), OTHER_AT, OTHER_LEAST)
    return ascii_only, float(least), most * float(np.sqrt(len(cells) / max(1, ((cells & 0xC0) != 0x80).sum())))


def _document_most(length: int) -> float:
    return DOCUMENT_MOST[bisect_right(DOCUMENT_MOST, (length, 9e9)) - 1][1]


def compression_verdict(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, bool]:
    """(ratio of the whole text, inside all bands)."""
    if not raw:
        return 0.0, True
    ratio = len(raw) / len(packer.compress(raw))
    _, least, most = _limits(raw, _document_most(len(raw)))
    if not least <= ratio <= most:
        return ratio, False
    noise = above = 0
    for i in range(0, len(raw), CHUNK):
        c = raw[i : i + CHUNK]
        r = len(c) / len(packer.compress(c))
        ascii_only, least, most = _limits(c, CHUNK_MOST if len(c) == CHUNK else _document_most(len(c)))
        noise += len(c) * (r < least or ascii_only and len(c) >= PAIRS_FROM and pair_gain(c) < PAIR_GAIN)
        above += len(c) * (r > most)
    return ratio, bool(noise <= NOISE_SHARE * len(raw) and above <= CHUNK_SHARE * len(raw))


def repeated_words(words: Words, k: int = 5) -> np.ndarray:
    """For each row, its words in k-word windows that the row has twice or more."""
    n = words.counts()
    per = np.maximum(n - k + 1, 0)
    row = np.repeat(np.arange(len(n)), per)
    start = words.ptr[:-1][row] + np.arange(per.sum()) - (np.cumsum(per) - per)[row]
    # the row is part of the hash, so equal hashes are in one row
    key = Ranges(words.hash).hash(start, start + k) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(words.hash), bool)
    twice[start[order[1:][same]]] = True
    twice[start[order[:-1][same]]] = True
    covered = np.concatenate(([0], np.cumsum(cover(twice, k))))
    return covered[words.ptr[1:]] - covered[words.ptr[:-1]]


def duplicate_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _rules(columns: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            kept_columns = batch.select(columns)
            for at, end, data, offsets in text_slices(batch, text):
                words = Words(data, offsets)
                n = words.counts()
                inside = np.zeros(len(data) + 1, np.int8)
                inside[words.start] += 1
                inside[words.end] -= 1
                letters = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
                repeats = repeated_words(words)
                failed = (n < 10) | (100 * repeats > 20 * n)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                verdict = [compression_verdict(t, packer) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*kept_columns.slice(at, end - at).columns, *map(pa.array, (
                        n.astype(np.int64), _per_row(letters, offsets), _per_row(SYMBOLS[data], offsets),
                        np.fromiter(map(duplicate_lines, texts), np.int64, len(texts)), repeats.astype(np.int64), failed,
                        np.fromiter((v[0] for v in verdict), float, len(texts)),
                        np.fromiter((v[1] for v in verdict), bool, len(texts)) & ~failed))],
                    names=[*columns, *(f.split()[0] for f in FIELDS.split(", "))],
                )

    return run


def quality_rules(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, default all) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, ratio, kept.

    Null and empty texts have no words, so they fail the base rule. Each row is judged alone, so
    repeated rows get equal results; texts are judged whole at any length. No shuffle; an empty table gives an empty result; columns
    of docs with the names above are replaced.
    """
    bounded_batches(docs.sparkSession)
    made = [f.split()[0] for f in FIELDS.split(", ")]
    columns = [c for c in keep or docs.columns if c.lower() not in made]
    schema = docs.select(*columns).schema
    text = fresh("_text", columns)
    source = docs.select(*columns, docs["text"].cast("string").alias(text))
    return source.mapInArrow(_rules(columns, text), StructType([*schema.fields, *StructType.fromDDL(FIELDS).fields]))


def good_documents(docs: DataFrame) -> DataFrame:
    """Rows of docs that the rules keep, with the columns of docs and their own values, whatever their names."""
    safe, back = aside(docs, [f.split()[0] for f in FIELDS.split(", ")])
    return back(quality_rules(safe).where("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of all documents (see quality_rules)."""
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
