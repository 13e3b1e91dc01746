"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Training runs on the driver in numpy, on a bounded sample of labelled rows that is split three
ways by hash: lexicons are drawn from one part, trees grown on the next, and their outputs
calibrated on the last. Every row is then scored, whole, in one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import SAMPLE_BYTES, held_out
from .shared import bounded_batches, table
from .textkit import BYTE_VALUES, LOWER, Ranges, Words, text_slices

#: Labelled rows of each class to learn from, at most about.
SAMPLE_PER_CLASS = 3000
#: Trees, depth, learning rate, bins of a feature, least rows in a leaf.
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 32, 10
#: Lexicon entries: in at least LEAST toxic texts and with a log-odds of at least ODDS.
LEAST, ODDS, PREFIXES, NEAR = 4, 2.0, (5, 7), 4
#: Second-person words of the languages at hand, and characters used to disguise letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes tú ti vosotros".split()
DISGUISES = b"@$0134578!*_"

WORD_BREAKS = np.ones(256, bool)
WORD_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x27, *DISGUISES]] = False


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, ALPHA, DIGIT = _flags(bytes(range(0x41, 0x5B))), _flags(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])), _flags(b"0123456789")
SHOUT, PUNCT, DISGUISE = _flags(b"!?"), _flags(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), _flags(DISGUISES)


def word_hashes(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    return np.unique(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True).hash)


class Tokens:
    """Words of a slice with the hashes that lexicons go by: the whole word and prefixes of it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(data, offsets, lower=True, white=WORD_BREAKS)
        self.size = self.words.end - self.words.start
        ranges = Ranges(LOWER[data], BYTE_VALUES)
        self.keys = [self.words.hash, *(np.where(self.size > n, ranges.hash(self.words.start, np.minimum(self.words.start + n, self.words.end)), np.uint64(0)) for n in PREFIXES)]


@dataclass
class Lexicon:
    """Sorted hashes with their log-odds, one pair for each kind of key."""

    entries: list[tuple[np.ndarray, np.ndarray]]

    def weights(self, kind: int, keys: np.ndarray) -> np.ndarray:
        known, odds = self.entries[kind]
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, odds[at], 0.0)


def draw_lexicon(texts: list[bytes], toxic: np.ndarray) -> Lexicon:
    entries = []
    tokens = [Tokens(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    for kind in range(1 + len(PREFIXES)):
        bags = [np.unique(t.keys[kind]) for t in tokens]
        bad, bad_n = np.unique(np.concatenate([b for b, x in zip(bags, toxic, strict=True) if x] or [np.zeros(0, np.uint64)]), return_counts=True)
        good, good_n = np.unique(np.concatenate([b for b, x in zip(bags, toxic, strict=True) if not x] or [np.zeros(0, np.uint64)]), return_counts=True)
        at = np.minimum(np.searchsorted(good, bad), max(0, len(good) - 1))
        other = np.where(good[at] == bad, good_n[at], 0) if len(good) else np.zeros(len(bad))
        odds = np.log((bad_n + 0.5) / (n_bad + 1)) - np.log((other + 0.5) / (n_good + 1))
        keep = (bad_n >= LEAST) & (odds >= ODDS) & (bad != 0)
        entries.append((bad[keep], odds[keep]))
    return Lexicon(entries)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Dense features, one row for each text."""
    tokens = Tokens(data, offsets)
    words, rows = tokens.words, len(offsets) - 1
    ptr, n = words.ptr, np.maximum(words.counts(), 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def per_word(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(x)))
        return total[ptr[1:]] - total[ptr[:-1]]

    def per_byte(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def largest(x: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(np.diff(ptr))
        out = np.zeros(rows)
        if len(full):
            out[full] = np.maximum.reduceat(x, ptr[:-1][full])
        return out

    out: list[np.ndarray] = [np.log1p(words.counts()), per_word(tokens.size) / n]
    second = np.isin(words.hash, YOU)
    near = np.concatenate(([0], np.cumsum(second)))
    at = np.arange(len(words.hash))
    beside = near[np.minimum(at + NEAR + 1, len(at))] > near[np.maximum(at - NEAR, 0)]
    odds = [lexicon.weights(kind, keys) for kind, keys in enumerate(tokens.keys)]
    for x in [*odds, np.max(odds, axis=0) if odds else np.zeros(0)]:
        hits = per_word(x > 0)
        out += [hits, hits / n, per_word(x) / n, largest(x)]
    out += [per_word(second) / n, per_word(beside & (odds[0] > 0)) / n]
    letters = np.maximum(per_byte(ALPHA[data]), 1)
    out += [per_byte(UPPER[data]) / letters, per_byte(SHOUT[data]) / size, per_byte(PUNCT[data]) / size, per_byte(DIGIT[data]) / size]
    inner = np.zeros(len(data), bool)  # disguises right between letters
    inner[1:-1] = DISGUISE[data[1:-1]] & ALPHA[data[:-2]] & ALPHA[data[2:]]
    triple = np.zeros(len(data), bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & ALPHA[data[2:]] & (data[2:] < 0x80)
    return np.column_stack([*out, per_byte(inner) / n, per_byte(triple) / n])


YOU = word_hashes(SECOND_PERSON)


@dataclass
class Boosted:
    """Trees of a fixed depth: split features and thresholds by level order, leaf values; then an isotonic step function."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    steps: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.interp(raw, self.steps, self.levels) if len(self.steps) else 1 / (1 + np.exp(-raw))


def grow(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Newton boosting of the logistic loss, with splits at quantile bins."""
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
    raw, trees, inner = np.full(len(y), base), [], 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 0.0
            for f in range(x.shape[1]) if len(own) >= 2 * LEAF else ():
                g, h, c = (np.bincount(binned[own, f], w, BINS + 1).cumsum() for w in (grad[own], hess[own], np.ones(len(own))))
                ok = (c >= LEAF) & (c[-1] - c >= LEAF)
                gain = np.where(ok, g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1), 0)[: len(cuts[f])]
                if len(gain) and gain.max() > best + 1e-9:
                    best, feature[node], threshold[node] = float(gain.max()), f, cuts[f][int(gain.argmax())]
            at[own] = 2 * node + 1 + (x[own, feature[node]] > threshold[node])
        for i in range(inner + 1):
            own = np.flatnonzero(at == inner + i)
            leaf[i] = RATE * grad[own].sum() / (hess[own].sum() + 1)
        raw += leaf[at - inner]
        trees.append((feature, threshold, leaf))
    return Boosted(trees, base, np.zeros(0), np.zeros(0))


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators fit, as points to interpolate between."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of w*y, sum of w, first raw, last raw
    for r, v, w in zip(raw[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([w * v, w, r, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + top[0], blocks[-1][1] + top[1], blocks[-1][2], top[3]]
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.clip(self.trees.score(features(data, offsets, self.lexicon)), 0, 1)


def train(texts: list[bytes], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = 5) -> ToxicityModel:
    """weights: how many corpus rows a sampled row stands for, for labels 0 and 1; calibration goes by them."""
    y = np.array(toxic, float)
    part = np.random.default_rng(seed).permutation(len(y)) % 10
    def pick(ok):
        return [t for t, k in zip(texts, ok.tolist(), strict=True) if k]
    lexicon = draw_lexicon(pick(part < 4), y[part < 4] > 0)
    def table_of(ok):
        own = pick(ok)
        raw = b"".join(own)
        return features(np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in own]))).astype(np.int64), lexicon)
    grown, calibrated = (part >= 4) & (part < 8), part >= 8
    trees = grow(table_of(grown), y[grown]) if grown.any() else Boosted([], 0.0, np.zeros(0), np.zeros(0))
    if calibrated.any():
        trees.steps, trees.levels = isotonic(trees.raw(table_of(calibrated)), y[calibrated], np.where(y[calibrated] > 0, weights[1], weights[0]))
    return ToxicityModel(lexicon, trees)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel | None:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {0: 0, 1: 0}
    for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect():
        counts[r.toxic] += r["count"]
    if not sum(counts.values()):
        return None
    share = F.when(F.col("toxic") > 0, F.lit(per_class / max(1, counts[1]))).otherwise(F.lit(per_class / max(1, counts[0])))
    # the choice is bounded, so it may be broadcast
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20) < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * per_class)
    rows = docs.where(~held_out(F.col("doc_id")) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)).join(F.broadcast(chosen), "doc_id").select("text", "toxic").orderBy(F.xxhash64("text", "toxic")).limit(8 * per_class).toPandas()
    pairs = sorted(((t or "").encode(), int(x > 0)) for t, x in zip(rows["text"], rows["toxic"], strict=True))
    return train([t for t, _ in pairs], [x for _, x in pairs], tuple(max(1.0, counts[k] / per_class) for k in (0, 1))) if pairs else None


def _score(model: ToxicityModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch):
                score = model.score(data, offsets) if model else np.zeros(end - at)
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(["doc_id", "held_out"]).slice(at, end - at).columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text, ...).

    labels(doc_id, toxic, ...): the greatest label of a doc_id counts; null labels and rows held
    out (crc32 of doc_id mod 5 is 0) are never learned from. Null and empty texts get the score
    of an empty text. Without any label every score is 0. Repeated rows get equal scores; an
    empty table gives an empty result; other columns are ignored, so their names can't clash. Texts
    are scored whole at any length, a very long one by itself.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model = learn(docs, labels.select("doc_id", "toxic"), per_class)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents (see score_toxicity)."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
