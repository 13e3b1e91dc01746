"""Vectorised text helpers that run inside Spark tasks on Arrow batches.

Everything works on the UTF-8 bytes of a bounded slice of rows, so memory follows the
slice (or one single very long document), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed constants of the 64-bit hashes.
MULT = np.uint64(0x9E3779B97F4A7C13)
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SLICE_BYTES = 1 << 20
#: Tokens that are hashed at a time: what a long text takes beside its own bytes follows this, not its length.
BLOCK = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_table(base: np.uint64) -> np.ndarray:
    step = np.full(BLOCK + 1, base, np.uint64)
    step[0] = 1
    return np.cumprod(step)


_UP, _DOWN = _power_table(MULT), _power_table(MULT_INV)


class Ranges:
    """Hashes of any token range from prefix sums of value * MULT**position, block by block.

    table, if given, maps tokens (bytes) to their values as blocks are read. Starts and ends of
    one call must each be in rising order.
    """

    def __init__(self, tokens: np.ndarray, table: np.ndarray | None = None):
        self.tokens, self.table = tokens, table
        self.whole = self._sums(0, len(tokens)) if len(tokens) <= BLOCK else None

    def _sums(self, a: int, b: int) -> np.ndarray:
        values = self.tokens[a:b] if self.table is None else self.table[self.tokens[a:b]]
        out = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values * _UP[: b - a], out=out[1:])
        return out

    def _prefix(self, at: np.ndarray) -> np.ndarray:
        """Prefix sums at rising positions."""
        out, before, scale = np.empty(len(at), np.uint64), 0, 1
        for a in range(0, len(self.tokens), BLOCK):
            b = min(a + BLOCK, len(self.tokens))
            sums = self._sums(a, b) * np.uint64(scale)
            lo, hi = np.searchsorted(at, (a, b + 1 if b == len(self.tokens) else b))
            out[lo:hi] = np.uint64(before) + sums[at[lo:hi] - a]
            before, scale = (before + int(sums[-1])) % (1 << 64), scale * int(_UP[BLOCK]) % (1 << 64)
        return out

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.whole is not None:
            raw = (self.whole[end] - self.whole[start]) * _DOWN[start]
        else:
            raw = self._prefix(end) - self._prefix(start)
            block, scale = start // BLOCK, np.empty(-(-len(self.tokens) // BLOCK) + 1, np.uint64)
            scale[0], scale[1:] = 1, _DOWN[BLOCK]
            raw *= np.cumprod(scale)[block] * _DOWN[start - block * BLOCK]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about `most` bytes; null texts are empty."""
    col = batch.column(column)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, kind, count=len(col) + 1, offset=col.offset * np.dtype(kind).itemsize).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a slice: hashes, byte spans, and first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, white: np.ndarray = WHITE):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~white[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | first[1:-1]
        closes[:-1] &= ~inside[1:] | first[1:-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.ptr = np.searchsorted(self.start, offsets)
        self.hash = Ranges(data, BYTE_VALUES).hash(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and first shingle of each row; a row of fewer words has its whole sequence as one."""
    n = words.counts()
    per = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    ptr = np.concatenate(([0], np.cumsum(per)))
    row = np.repeat(np.arange(len(n)), per)
    start = words.ptr[:-1][row] + np.arange(ptr[-1]) - ptr[:-1][row]
    return Ranges(words.hash).hash(start, np.minimum(start + k, words.ptr[1:][row])), ptr


def anchored_windows(tokens: np.ndarray, ptr: np.ndarray, length: int, k: int, table: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Cut all windows of `length` tokens into runs that share their anchor.

    The anchor of a window is its k-gram of smallest hash (leftmost of equals), so equal windows
    have equal anchors at equal places. Returns for each run: row, first window's start (token
    position in the slice), number of windows, anchor hash, hash of all tokens that it covers,
    anchor's position in the slice. Works block by block; a block begins where a run does, so
    runs don't depend on where blocks are cut. table: see Ranges.
    """
    parts, at = [], 0
    while at + length <= len(tokens):
        end = min(len(tokens), at + BLOCK)
        found, upto = _anchored_block(tokens[at:end], ptr, at, length, k, table, end == len(tokens))
        parts.append(found)
        at = upto
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)
    return tuple(np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate(kinds))


def _anchored_block(tokens: np.ndarray, ptr: np.ndarray, base: int, length: int, k: int, table: np.ndarray | None, last: bool) -> tuple[tuple[np.ndarray, ...], int]:
    """(the block's runs, where the next block begins); base: position of the block's first token."""
    n = len(tokens)
    ranges = Ranges(tokens, table)
    at = np.arange(n - k + 1)
    grams = ranges.hash(at, at + k)
    low, width, span = grams >> np.uint64(17) << np.uint64(17) | at.astype(np.uint64), length - k + 1, 1  # a block has at most 2**16 tokens
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & np.uint64(0x1FFFF)).astype(np.int64)
    begin = np.arange(n - length + 1)
    row = np.searchsorted(ptr, begin + base, side="right") - 1
    inside = begin + base + length <= ptr[row + 1]
    start, row, mine = begin[inside], row[inside], anchor[inside]
    cut = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (row[1:] != row[:-1])))) if len(start) else start
    count = np.diff(np.concatenate((cut, [len(start)])))
    upto = base + n - length + 1
    if not last and len(start) and inside[-1]:  # the last run may go on: it begins the next block
        upto = base + int(start[cut[-1]])
        cut, count = cut[:-1], count[:-1]
    first = start[cut]
    return (row[cut], first + base, count, grams[mine[cut]], ranges.hash(first, first + count - 1 + length), mine[cut] + base), upto


def cover(marks: np.ndarray, length: int) -> np.ndarray:
    """Tokens covered by windows of `length` that start where marks is true."""
    step = np.zeros(len(marks) + length + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step)[: len(marks)] > 0
