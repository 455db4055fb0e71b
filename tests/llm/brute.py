"""The contracts, restated one document at a time."""
from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LAST = 1 << 63


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rank(i):
    return LAST if i is None else i


def repeats(docs, units, width):
    """For each document the units that a window of an earlier document covers."""
    first: dict = {}
    for i, t in docs:
        u = units(t)
        for j in range(len(u) - width + 1):
            k = tuple(u[j : j + width])
            first[k] = min(first.get(k, LAST), rank(i))
    out = []
    for i, t in docs:
        u = units(t)
        gone = [False] * len(u)
        for j in range(len(u) - width + 1):
            if first[tuple(u[j : j + width])] < rank(i):
                gone[j : j + width] = [True] * width
        out.append((i, u, gone))
    return out


def suffix_dedup(docs, width=50):
    return [
        (i, len(u), sum(g), len(re.findall("x+", "".join("x" if x else "." for x in g))), sha(bytes(b for b, x in zip(u, g, strict=True) if not x)))
        for i, u, g in repeats(docs, lambda t: (t or "").encode(), width)
    ]


def substring_dedup(docs, width=50):
    return [(i, len(u), sum(g), sha(" ".join(w for w, x in zip(u, g, strict=True) if not x))) for i, u, g in repeats(docs, lambda t: NOT_SPACE.findall(t or ""), width)]


class Union:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def shingles(text, n=5):
    w = NOT_SPACE.findall((text or "").translate(LOWER))
    k = min(n, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def ngram_components(docs, n=5, percent=80):
    sets = [shingles(t, n) for _, t in docs]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    u = Union()
    for k, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in by[x] if j < k).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                u.join(j, k)
    least: dict = {}
    for k, (i, _) in enumerate(docs):
        c = u.find(k)
        least[c] = min(least.get(c, LAST), rank(i))
    return [(i, len(sets[k]), None if least[u.find(k)] == LAST else least[u.find(k)]) for k, (i, _) in enumerate(docs)]


def contamination(docs, items, window=13):
    cut = lambda t: ALNUM.findall((t or "").translate(LOWER))
    wanted = defaultdict(set)
    for name, t in items:
        w = cut(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            wanted[tuple(w[j : j + k])].add("" if name is None else str(name))
    sizes = {len(k) for k in wanted}
    out = []
    for i, t in docs:
        w, names = cut(t), set()
        hit = [False] * len(w)
        for k in sizes:
            for j in range(len(w) - k + 1):
                if found := wanted.get(tuple(w[j : j + k])):
                    names |= found
                    hit[j : j + k] = [True] * k
        n = sum(hit)
        out.append((i, len(w), n, len(names), sha(",".join(sorted(names))), n > 0 and 20 * n >= len(w)))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def dedup_lines(docs, edits=2, min_chars=24):
    u, seen = Union(), []
    for i, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                seen.append((i, p, line))
    lines = sorted({x[2] for x in seen})
    long = [x for x in lines if len(x) >= min_chars]
    for k, a in enumerate(long):
        for b in long[:k]:
            if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                u.join(a, b)
    first: dict = {}
    for i, p, line in seen:
        c = u.find(line)
        first[c] = min(first.get(c, (rank(i), p)), (rank(i), p))
    gone = defaultdict(set)
    for i, p, line in seen:
        if first[u.find(line)] != (rank(i), p):
            gone[i].add(p)
    return [(i, len(ls := (t or "").split("\n")), len(gone[i]), sha("\n".join(x for p, x in enumerate(ls) if p not in gone[i]))) for i, t in docs]


def longest_matches(docs, items, known=None, window=13):
    """Words of the longest match with any test suffix where a window begins, by document; ``known`` where items are only judged in blocks."""
    if known is not None:
        return known
    tests = [ALNUM.findall((t or "").translate(LOWER)) for _, t in items]
    windows = {tuple(item[q : q + min(window, len(item))]) for item in tests for q in range(max(0, len(item) - window) + 1) if item}
    out = {}
    for i, t in docs:
        w, best = ALNUM.findall((t or "").translate(LOWER)), 0
        for p in range(len(w)):
            if not any(tuple(w[p : p + n]) in windows for n in range(1, window + 1)):
                continue
            for item in tests:
                for q in range(len(item)):
                    n = 0
                    while p + n < len(w) and q + n < len(item) and w[p + n] == item[q + n]:
                        n += 1
                    best = max(best, n)
        out[i] = best
    return out


M64 = (1 << 64) - 1


def _mix(h):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ (h >> 33)) * m) & M64
    return h ^ (h >> 33)


def _word_hash(word: bytes):
    from adlens.llm._bytes import _BASE, _BYTE

    return _mix(sum(int(_BYTE[1][b]) * pow(_BASE[1], k, 1 << 64) for k, b in enumerate(word)) & M64)


def quality_features(text, buckets):
    """Share of each feature in the text's words, from the feature's description."""
    kinds = {**dict.fromkeys(range(97, 123), 1), **dict.fromkeys(range(65, 91), 2), **dict.fromkeys(range(48, 58), 3), **dict.fromkeys(range(128, 256), 1)}
    kinds |= dict.fromkeys([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 4)
    out: Counter = Counter()
    found = [w.encode() for w in NOT_SPACE.findall(text)]
    before = None
    for w in found:
        h = _word_hash(w.lower() if w.isascii() else w.decode().translate(LOWER).encode())
        cls = [kinds.get(b, 0) for b in w]
        shape = 2 * (25 * cls[0] + 5 * cls[max(len(w) - 2, 0)] + cls[-1]) + (h == before)
        out[shape % 256] += 1 / len(found)
        out[256 + min(len(w), 40)] += 1 / len(found)
        out[512 + h % (buckets - 512)] += 0.5 / len(found)
        if before is not None:
            out[512 + _mix((before * 31 + h) & M64) % (buckets - 512)] += 0.5 / len(found)
        before = h
    return out


def quality_score(text, model):
    from math import exp

    return 1 / (1 + exp(-(model.bias + sum(model.weights[k] * x for k, x in quality_features(text, len(model.weights)).items()))))


def ftrl(texts, labels, buckets, epochs, alpha=1.0, beta=1.0, l1=0.02, l2=0.02, seed=11):
    import numpy as np
    from math import exp, sqrt

    z, n = defaultdict(float), defaultdict(float)
    rare = sum(labels) / len(labels)
    share = {1: rare, 0: 1 - rare}

    def weight(k):
        sign = (z[k] > 0) - (z[k] < 0)
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - sign * l1) / ((beta + sqrt(n[k])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            x = {**quality_features(texts[i], buckets), buckets: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + exp(-sum(w[k] * x[k] for k in x)))
            for k in x:
                g = (p - labels[i]) * 0.5 / share[labels[i]] * x[k]
                z[k] += g - (sqrt(n[k] + g * g) - sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return np.array([weight(k) for k in range(buckets)]), weight(buckets)


def mean_embedding(text, model):
    import numpy as np

    data, total, count = text.translate(LOWER).encode(), np.zeros(model.table.shape[1]), 0
    for order in model.orders:
        for i in range(len(data) - order + 1):
            h = order
            for b in data[i : i + order]:
                h = (h * 257 + b) & M64
            total += model.table[_mix(h) % len(model.table)]
            count += 1
    return total / max(count, 1)
