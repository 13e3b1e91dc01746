"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are byte n-grams of the lower-cased text. The model is trained on the driver by
stochastic gradient descent in numpy, on a bounded sample of labelled rows; every row is then
scored in one scan, whole. Since the softmax is linear, embedding and output layer fold into
one table of per-language scores for each subword, and a text's logits are a mean of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, table
from .textkit import BYTE_VALUES, LOWER, text_slices

#: n-gram lengths, hash buckets, embedding width, passes, learning rate, and rows to learn from for each language.
GRAMS, BUCKETS, WIDTH, EPOCHS, RATE, SAMPLE_PER_LANG = (2, 3, 4), 1 << 15, 16, 6, 2.0, 500
#: Bytes of a text to learn from, at most: it bounds what the driver gathers. Scoring knows no such limit.
SAMPLE_BYTES = 1 << 15
#: Languages that are learned, the most frequent first, and rows of all of them together: these bound the sample too.
MOST_LANGS, SAMPLE_ROWS = 1000, 40_000
#: Part of the sample that sets temperature and rejection; share of its right answers that rejection may cost.
VALIDATION, REJECT_RIGHT = 0.25, 0.01
SLICE = 1 << 18
RESULT = "lang_pred string, score double, rejected boolean"
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of each n-gram, by start; one array for each length."""
    values = BYTE_VALUES[LOWER[data]]
    out, key = [], values
    for n in range(2, max(GRAMS) + 1):
        key = (key[:-1] * np.uint64(0x9E3779B97F4A7C13)) ^ values[n - 1 :]
        if n in GRAMS:
            mixed = key * np.uint64(0xD6E8FEB86659FD93)
            out.append((mixed >> np.uint64(49)).astype(np.int64) & (BUCKETS - 1))
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        total, count = np.zeros((rows, len(self.langs))), np.zeros(rows)
        for n, index in zip(GRAMS, subwords(data), strict=True):
            per = np.maximum(np.diff(offsets) - n + 1, 0)
            ok = np.flatnonzero(per)
            if not len(ok):
                continue
            edges = np.minimum(np.column_stack((offsets[:-1][ok], offsets[:-1][ok] + per[ok])).reshape(-1), len(index))
            gathered = np.concatenate((self.scores[index], np.zeros((1, len(self.langs)), np.float32)))
            total[ok] += np.add.reduceat(gathered, edges, axis=0)[::2]
            count[ok] += per[ok]
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> LanguageModel | None:
    """None if nothing is to be learned."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([names.index(x) for x in langs])
    bags = []
    for t in texts:
        index = np.concatenate(subwords(np.frombuffer(t, np.uint8)) or [np.zeros(0, np.int64)])
        u, n = np.unique(index, return_counts=True)
        bags.append((u, (n / max(1, n.sum())).astype(np.float32)))
    order = rng.permutation(len(texts))
    cut = int(len(order) * VALIDATION) if len(order) >= 20 else 0
    held, used = order[:cut], order[cut:]
    table_ = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((len(names), WIDTH), np.float32), np.zeros(len(names), np.float32)
    steps, total = 0, EPOCHS * len(used)
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            u, share = bags[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = share @ table_[u]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden).astype(np.float32)
            bias -= 0.1 * rate * p.astype(np.float32)
            table_[u] -= (rate * share[:, None]) * back[None, :]
    model = LanguageModel(names, (table_ @ out.T).astype(np.float32), bias)
    if cut:
        z = np.array([bags[i][1] @ model.scores[bags[i][0]] + bias for i in held])
        losses = []
        grid = np.geomspace(0.05, 5, 41)
        for t in grid:
            model.temperature = float(t)
            losses.append(-np.log(np.maximum(model.probabilities(z)[np.arange(cut), label[held]], 1e-12)).mean())
        model.temperature = float(grid[int(np.argmin(losses))])
        p = model.probabilities(z)
        right = p.max(axis=1)[p.argmax(axis=1) == label[held]]
        model.threshold = float(np.quantile(right, REJECT_RIGHT)) if len(right) else 0.0
    return model


def learn(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> LanguageModel | None:
    """Train on about `per_lang` rows for each language, chosen by hash among those not held out."""
    usable = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & ~held_out(F.col("doc_id")))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    if not counts:
        return None
    per_lang = min(per_lang, SAMPLE_ROWS // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_lang / n)])[F.col("lang")]
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20) < share)
    # by hash as well, so that reruns agree where many rows share a doc_id and the limit bites
    rows = chosen.select("text", "lang").orderBy(F.xxhash64("text", "lang")).limit(2 * per_lang * len(counts)).toPandas()
    # a fixed order, whatever order the rows came in
    pairs = sorted((t.encode(), lang) for t, lang in zip(rows["text"], rows["lang"], strict=True))
    return train([t for t, _ in pairs], [lang for _, lang in pairs])


def _predict(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch, most=SLICE):
                found = np.concatenate(([0], np.cumsum(LETTERS[data])))
                letters = found[offsets[1:]] > found[offsets[:-1]]
                for i in np.flatnonzero(~letters).tolist():
                    letters[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                if model is None:
                    names, score, rejected = [None] * (end - at), np.zeros(end - at), np.ones(end - at, bool)
                else:
                    p = model.probabilities(model.logits(data, offsets))
                    best = p.argmax(axis=1)
                    names, score = [model.langs[b] for b in best.tolist()], np.where(letters, p.max(axis=1), 0.0)
                    rejected = ~letters | (score < model.threshold)
                names = [x if x is not None and ok else "und" for x, ok in zip(names, letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "held_out"]).slice(at, end - at).columns, pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify_languages(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of docs(doc_id, text, lang, ...).

    lang_pred is the likeliest learned language; `und` with score 0 if the text is null or has no
    letter, or if there was nothing to learn from. score is the calibrated probability.
    rejected tells answers below the calibrated threshold. Null doc_ids count as an empty string
    in the split. Repeated rows get equal answers; an empty table gives an empty result; other
    columns are ignored, so their names can't clash. Texts are scored whole at any length, a very long one
    by itself.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn(docs, per_lang)
    source = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return source.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, {RESULT}")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents (see identify_languages)."""
    return identify_languages(table(spark, sf_dir, "documents"))
