"""Filter audit, pivot search and prefix trie against plain versions, with odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import brute
import numpy as np
import pytest

from cairn.llm import filter_audit, pivot_search
from cairn.llm.filter_audit import audit_filters
from cairn.llm.pivot_search import Shelf, Space, spread_out, top_by_inner_product
from cairn.llm.prefix_trie import Conversation, peel, prefix_trie

DOC = "doc_id long, text string, lang string, mask string, part string, digest string, least string, quality string"
LABEL = "doc_id long, quality int, toxic int, part string"


def plain_audit(docs, labels):
    good, bad = ({d for d, q, t, *_ in labels if v(q, t) == 1} for v in (lambda q, t: q, lambda q, t: t))
    first = {}
    for d, t, *_ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = defaultdict(list)
    for d, text, lang, *_ in docs:
        t = text or ""
        w = brute.WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d,
        }
        rows[lang or ""].append((fails, d is not None and d in good, d is not None and d in bad))
    out, shares = {}, Counter()
    for part, of in rows.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [r for r in of if r[0][f] and not any(r[0][g] for g in order[:k])]
                shares[part, f] += len(here)
                out[part, order, k + 1] = (
                    sum(not any(r[0][g] for g in order[: k + 1]) for r in of), len(here), sum(r[0][f] for r in of) - len(here),
                    sum(r[0][f] and sum(r[0].values()) == 1 for r in of), sum(r[1] for r in here), sum(r[2] for r in here))
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def text_of(rng):
    words = [f"{rng.choice('abcdeABCZé')}{rng.randint(0, rng.choice([20, 5000]))}" for _ in range(rng.choice([0, 5, 99, 100, 140]))]
    return rng.choice([" ", "\n", " \t"]).join(words) + rng.choice(["", "", " #", " %|"])


def test_audit_matches_brute_force(spark):
    rng = random.Random(4)
    texts = [text_of(rng) for _ in range(25)]
    docs = [(rng.choice([None, *range(60)]), rng.choice([None, "", *texts]), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    docs += [docs[7]] * 3 + [(1, texts[0], "en"), (1, texts[0], "de"), (2, texts[0], "en")]
    docs = [(*d, "own", "own", "own", "own", "own") for d in docs]
    labels = [(d, rng.choice([None, 0, 1]), rng.choice([None, 0, 1]), "x") for d in [*range(0, 60, 2), 4, 4, None]]
    out = audit_filters(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    assert got == plain_audit(docs, labels)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert audit_filters(spark.createDataFrame([], DOC), spark.createDataFrame([], LABEL)).count() == 0
    alone = audit_filters(spark.createDataFrame(docs[:1], DOC), spark.createDataFrame([], LABEL)).collect()
    assert len(alone) == 600


def test_long_texts_are_judged_whole():
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400_000)]
    raw = "\n".join(words).encode()
    assert len(raw) > 2 * filter_audit.PIECE
    assert filter_audit.word_counts(raw) == (len(words), len(set(words)))
    assert filter_audit.word_counts(b"x" * (3 * filter_audit.PIECE)) == (1, 1)
    assert filter_audit.failures(b"a " * 10**6 + b"|") == 0b1010


VECTOR = "vec_id long, embedding array<float>, label int, near int, score long, query string"


def plain_search(rows, every, k):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q is None or q % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), c) for c, b in usable if c is None or c != q]
        best = sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1]))[:k]
        out += [(q, n + 1, c, s) for n, (s, c) in enumerate(best)]
    return out


def vector_rows(seed, n, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(i - 40, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], 1, 2, 3, "own") for i in range(n)]


def by_order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, v) for v in r])


def test_search_matches_brute_force(spark):
    odd = [(None, [1.0] * 6), (500, None), (600, [1.0, None] * 3), (700, [math.nan] * 6), (800, [math.inf] * 6), (900, []), (1000, [0.5, -0.5]), (1100, [0.0] * 6), (1101, [0.3] * 6)]
    rows = vector_rows(3, 700) + [(*o, 0, 0, 0, "own") for o in odd]
    rows += [rows[50]] * 12 + [(10, r[1], *r[2:]) for r in rows[60:64]] + [(7000 + i, *rows[40][1:]) for i in range(30)] + [(None, *rows[41][1:])] * 2
    for block_bytes in (1 << 21, 1 << 11):
        got = top_by_inner_product(spark.createDataFrame(rows, VECTOR), every=10, k=10, block_bytes=block_bytes)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert by_order(got.collect()) == by_order(plain_search(rows, 10, 10))


def test_search_in_few_or_no_rows(spark):
    rows = vector_rows(5, 4)
    rows = [(100 * i, *r[1:]) for i, r in enumerate(rows)]
    assert by_order(top_by_inner_product(spark.createDataFrame(rows, VECTOR)).collect()) == by_order(plain_search(rows, 100, 10))
    assert top_by_inner_product(spark.createDataFrame([], VECTOR)).count() == 0
    assert top_by_inner_product(spark.createDataFrame(rows[:1], VECTOR)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        top_by_inner_product(spark.createDataFrame([(0, [1e30] * 6, 0, 0, 0, "")], VECTOR))
    large = [(100 * i, [float(np.float32(r * (1 << 15))) for r in row[1]], *row[2:]) for i, row in enumerate(rows)]  # products beyond 2**53
    assert by_order(top_by_inner_product(spark.createDataFrame(large, VECTOR)).collect()) == by_order(plain_search(large, 100, 10))


def test_bounds_eliminate_in_clusters():
    rng = np.random.default_rng(2)
    cells = np.floor(1024 * (rng.normal(0, 1, (20, 8))[rng.integers(0, 20, 4000)] + rng.normal(0, 0.02, (4000, 8)))).astype(np.int32)
    space = Space(8, int(abs(cells).max()), float((cells.astype(float) ** 2).sum(1).max()), spread_out(cells[:500], 16))
    far = space.distances(cells).astype(np.float32)
    seen = 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal seen
            seen += len(self)
            return np.asarray(self) @ other

    shelf = Shelf(space, [{"n": len(cells), "ids": np.arange(4000).tobytes(), "named": np.ones(4000, bool).tobytes(), "cells": cells.tobytes(), "pivot_dist": np.ascontiguousarray(far.T).tobytes(), "low": far.min(0).tolist(), "high": far.max(0).tolist()}])
    shelf.cells = shelf.cells.view(Counted)
    step, pivot_search.STEP = pivot_search.STEP, 64
    try:
        for q in range(0, 4000, 100):
            rows, scores = shelf.best(cells[q], q, 10, None)
            exact = cells.astype(np.int64) @ cells[q].astype(np.int64)
            exact[q] = -(1 << 60)
            best = np.lexsort((np.arange(4000), -exact))[:10]
            assert rows.tolist() == best.tolist()
            assert scores.tolist() == exact[best].tolist()
    finally:
        pivot_search.STEP = step
    assert seen < 0.5 * 40 * 4000


TURN = "conv_id long, turn long, role string, text string, depth string, key string, path string, nth string"


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(of)] for c, of in turns.items()}
    built = {}
    for c, of in own.items():
        h = crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + of[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    out = []
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        childless = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in of if len(built[c]) == len(node))
        out.append((of[0], len(node), members[node[:-1]][0] if node else None, len(of), len(kids), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk_rows(seed, n=40, most=14, words=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        script = rng.randint(0, 2)
        for t in range(rng.randint(1, most)):
            rows.append((c * rng.choice([1, 1, -1]), t, rng.choice(["user", "assistant"]) if t > 6 else "user", f"{script} {t}" if rng.random() < 0.8 else f"é{rng.randint(0, words)}"))
    return rows


@pytest.mark.parametrize("task_turns", [1 << 16, 20, 1])
def test_trie_matches_brute_force(spark, task_turns):
    rows = talk_rows(1)
    rows += [(100, None, "user", "x"), (100, None, None, None), (100, 2, None, "y"), (101, 1, "user", None), (101, 1, "user", None), (102, 1, "a", "b"), (102, 1, "a", "a"), (None, 1, "user", "x"), (10**12, 0, "user", "0 0")]
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1200, 5) for t in range(30)]
    snapshots = [(c, t, "user", f"grows {t}") for c in range(2000, 2100, 5) for t in range((c - 2000) // 5 + 1)]
    rows = [(*r, "own", "own", "own", "own") for r in rows + copies + snapshots]
    out = prefix_trie(spark.createDataFrame(rows, TURN), task_turns)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert by_order(out.collect()) == by_order(plain_trie(rows))


def test_trie_without_turns(spark):
    assert prefix_trie(spark.createDataFrame([], TURN)).count() == 0
    bare = [(c, 0, "user", "x", "", "", "", "") for c in range(1, 5)]  # the family's first is absent: some lose all turns
    got = by_order(prefix_trie(spark.createDataFrame(bare, TURN)).collect())
    assert got == by_order(plain_trie(bare))
    assert any(r[1] == 0 and r[4] == 0 for r in got) or len(got) > 1


def test_a_deep_path_is_peeled_in_one_pass():
    chain = [Conversation(i, 1, b"", [bytes([k % 251, k // 251]) for k in range(i + 1)], [1] * (i + 1)) for i in range(0, 2000, 10)]
    below, top = peel(chain)
    assert len(below) == 1990
    assert (top.convs, top.children, top.leaves) == (200, 1, 1)
    assert top.saved == sum(sum(i >= k for i in range(0, 2000, 10)) - 1 for k in range(1, 1991))
