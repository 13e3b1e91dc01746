import random

import brute
import pytest
from pyspark.sql import functions as F

from cairn.llm.near_dedup import band_count, near_duplicates, superminhash
from cairn.llm.substring_dedup import remove_known_windows
from cairn.llm.suffix_dedup import earlier_windows, remove_repeats
from cairn.llm.textkit import BYTE_VALUES, Ranges, anchored_windows, mix64

import numpy as np

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_shingles string, chunk string"


def noisy_rows(seed=4, n=60, words=30):
    """Copies and near copies of a few texts, with nulls, blanks, ties and one long text."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(300)}" for _ in range(words * rng.randint(1, 6))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "two words"), (1006, "ab " * 4000), (1007, "é" * 300)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA)


def test_superminhash_is_the_minimum_over_items():
    rng = np.random.default_rng(1)
    slots = 12
    rows = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 5, 0, 40)]

    def plain(items):
        out = [0xFFFFFFFF] * slots
        for item in items.tolist():
            p = list(range(slots))
            for j in range(slots):
                draw = int(mix64(np.array([item], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))[0])
                k = j + (((draw & 0xFFFFFFFF) * (slots - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                out[p[j]] = min(out[p[j]], draw >> 40 | j << 24)
        return out

    got = superminhash(np.concatenate(rows), np.concatenate(([0], np.cumsum(list(map(len, rows))))), slots)
    assert got.tolist() == [plain(r) for r in rows]


@pytest.mark.parametrize(("k", "percent", "rows", "block"), [(3, 85, 6, 400_000), (5, 80, 5, 500)])
def test_near_duplicates_match_brute_force(spark, k, percent, rows, block):
    data = noisy_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, data), k, percent, rows=rows, block_shingles=block).collect()}
    assert got == brute.near_groups(data, k, percent)


def test_near_duplicates_of_odd_rows(spark):
    data = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A B C D")]
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(frame(spark, data), 3, 85).collect())
    assert got == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("None", None, True), ("None", None, True)]
    assert near_duplicates(frame(spark, []), 3, 85).count() == 0
    words = [f"w{i}" for i in range(140)]
    data = [(1, " ".join(words[:100])), (1, " ".join(words)), (2, " ".join([*words[:139], "other"]))]  # one doc_id, two texts
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(frame(spark, data), 3, 85).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_bands_rarely_miss():
    assert (1 - 0.85**6) ** band_count(0.85, 6) <= 1e-7


def test_remove_repeats_matches_brute_force(spark):
    rng = random.Random(3)
    data = noisy_rows() + [(2000 + i, "".join(rng.choice("ab") for _ in range(rng.choice([0, 99, 100, 101, 300, 2000]))) * rng.choice([1, 2, 3])) for i in range(20)]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(frame(spark, data)).collect()}
    assert got == brute.remove_repeats(data, 100)


def test_hot_anchors_give_the_same_result(spark):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(130))
    data = noisy_rows() + [(3000 + i, "".join(rng.choice("xyz") for _ in range(150)) + line + "".join(rng.choice("uvw") for _ in range(150))) for i in range(40)]
    got = {r.doc_id: tuple(r)[1:] for r in remove_repeats(frame(spark, data), hot_members=2).collect()}
    assert got == brute.remove_repeats(data, 100)


@pytest.mark.parametrize("parts", [1, 3])
def test_remove_repeats_of_odd_rows(spark, parts):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    got = sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(frame(spark, [(None, text), (3, text), (3, text), (4, text)]).repartition(parts)).collect())
    assert got == [("3", got[0][1]), ("3", got[0][1]), ("4", 300), ("None", 0)]
    assert remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("hot", [2, 2000])
def test_rows_that_repeat_a_doc_id_lose_the_same(spark, parts, hot):
    rng = random.Random(5)
    a, b, x = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(3))
    data = [(1, b + a), (3, x + a), (3, x + a), (3, a + x), (4, x + a + x)]
    got = sorted((r.doc_id, r.n_removed) for r in remove_repeats(frame(spark, data).repartition(parts), hot_members=hot).collect())
    assert got == [(1, 0), (3, 150), (3, 150), (3, 150), (4, 450)]


def brute_later(texts, docs, rows, length):
    found = set()
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            w = t[j : j + length]
            if any(docs[k] < docs[i] and w in u for k, u in enumerate(texts)) or any(rows[k] == rows[i] and w in u for k, u in enumerate(texts[:i])) or w in t[: j + length - 1]:
                found.add((i, j))
    return found


def test_streamed_matching_statistics_match_brute_force():
    rng = random.Random(9)
    for n in (1, 2, 7, 40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(9, 30))) for _ in range(n)] + [b"a" * 20, b"ab" * 9]
        docs = sorted(rng.randrange(6) for _ in texts)
        rows = [2 * d + (i % 2 if d % 2 else 0) for i, d in enumerate(docs)]
        order = sorted(range(len(texts)), key=lambda i: (docs[i], rows[i]))
        docs, rows = [docs[i] for i in order], [rows[i] for i in order]
        text, start = earlier_windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(list(map(len, texts))), np.array(docs), np.array(rows), 9)
        assert set(zip(text.tolist(), start.tolist())) == brute_later(texts, docs, rows, 9)


def test_long_texts_are_cut_into_the_same_runs():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, 200_000, dtype=np.uint8)
    text[5000:8000] = 97
    text[150_000:152_000] = text[10_000:12_000]
    ptr = np.array([0, 0, 30, 190_000, 190_000, 200_000])
    whole = anchored_windows(text, ptr, 100, 40, BYTE_VALUES)
    row, start, count, _, hashed, place = whole
    assert (np.diff(start) >= 0).all() and count.sum() == sum(max(0, b - a - 99) for a, b in zip(ptr, ptr[1:]))
    assert (start + count - 1 <= place).all() and (place - start <= 60).all()
    at = rng.integers(0, len(start), 200)
    assert (hashed[at] == Ranges(text, BYTE_VALUES).hash(start, start + count + 99)[at]).all()
    assert all(hashed[i] == Ranges(text[start[i] : start[i] + count[i] + 99], BYTE_VALUES).hash(np.array([0]), np.array([count[i] + 99]))[0] for i in at)
    again = {(a + 140_000, n) for a, n in zip(start[(start > 10_100) & (start < 11_700)], count[(start > 10_100) & (start < 11_700)])}
    assert again <= set(zip(start.tolist(), count.tolist()))


@pytest.mark.parametrize("batches", [1, 7])
def test_remove_windows_matches_brute_force(spark, batches):
    data = noisy_rows()
    got = {r.doc_id: tuple(r)[1:] for r in remove_known_windows(frame(spark, data), batches=batches).collect()}
    assert got == brute.remove_windows(data, 13)
    assert remove_known_windows(frame(spark, []), batches=batches).count() == 0
    odd = [(None, data[3][1]), (3, data[3][1]), (3, data[3][1]), (4, data[3][1])]
    removed = sorted((str(r.doc_id), r.n_removed == r.n_words) for r in remove_known_windows(frame(spark, odd), batches=batches).collect())
    assert removed == [("3", False), ("3", False), ("4", True), ("None", False)]


def test_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs).collect()} == brute.remove_repeats(rows, 100)
    assert {r.doc_id: tuple(r)[1:] for r in remove_known_windows(docs).collect()} == brute.remove_windows(rows, 13)
    near = near_duplicates(docs.withColumn("extra", F.lit(1)), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near} == brute.near_groups(rows, 3, 85)


def test_odd_nodes_of_a_hot_bucket(spark):
    """Near copies of one text, some too far from all others to link with the centre, in blocks of few shingles."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    data = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    rng.shuffle(data)
    data = [(n * 7 + 1, t) for n, (_, t) in enumerate(data)]
    for block in (400_000, 700):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, data), 3, 85, block_shingles=block).collect()}
        assert got == brute.near_groups(data, 3, 85)
