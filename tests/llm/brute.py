"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(0x41, 0x5B)}


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_groups(rows, k, percent):
    """doc_id -> (set size, smallest reachable doc_id), by all pairs that share a shingle."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    up, index = {d: d for d in sets}, defaultdict(list)

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for d in sorted(sets):
        shared = Counter(e for s in sets[d] for e in index[s])
        for s in sets[d]:
            index[s].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def remove_repeats(rows, length):
    """doc_id -> (bytes, removed, spans, sha256 of what is left)."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(raw[i : i + length])
        spans = sum(1 for i in range(len(raw)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest())
    return out


def remove_windows(rows, length):
    """doc_id -> (words, removed, sha256 of what is left)."""
    first, words = {}, {d: (t or "").encode().split() for d, t in rows}
    for d, w in words.items():
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def base_quality(text):
    """(words, word characters, symbols, duplicate lines, repeated words, base failed)."""
    t = text or ""
    w = WORD.findall(t)
    seen, lines = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), lines, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def contaminated(text, items):
    """Whether any 10-word window (or whole shorter item) of the items occurs in the text."""
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOWER))
    w = cut(text)
    for item in items:
        i = cut(item)
        n = min(10, len(i))
        windows = {tuple(i[j : j + n]) for j in range(len(i) - n + 1)} if n else set()
        if any(tuple(w[j : j + n]) in windows for j in range(len(w) - n + 1)):
            return True
    return False
