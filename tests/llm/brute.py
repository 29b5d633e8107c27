"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def jaccard(rows, width, percent):
    """rows: (doc_id, text) -> {doc_id: (n, component)}"""
    sets = {d: shingles(t, width) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    u = Union()
    for d, s in sets.items():
        u.find(d)
        both = defaultdict(int)
        for x in s:
            for other in where[x]:
                if other < d:
                    both[other] += 1
        for other, k in both.items():
            if 100 * k >= percent * (len(s) + len(sets[other]) - k):
                u.join(d, other)
    return {d: (len(s), u.find(d)) for d, s in sets.items()}


def repeats(texts, length=400):
    """bytes -> (n_bytes, n_removed, n_spans, sha256 of what stays) for each text"""
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[hash(b[i : i + length])] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def slots(text):
    """The slots of a text's byte 3-grams, word pairs and runs of one word."""
    from tidelake.llm import kernels
    from tidelake.llm import quality as q

    raw = (text or "").encode()
    found = set()
    for i in range(len(raw) - 2):
        gram = raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]
        found.add((gram * 0x9E3779B1 % 2**32) >> (32 - q.GRAM_BITS))
    h = [int(x) for x in kernels.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)[0]]
    same = [a == b for a, b in zip(h, h[1:], strict=False)]
    for i, (a, b) in enumerate(zip(h, h[1:], strict=False)):
        if a != b:
            slot = ((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93 % 2**64) >> (64 - q.PAIR_BITS)
            found.add((1 << q.GRAM_BITS) + (slot + q.RUNS if slot < q.RUNS else slot))
        for k in range(q.RUNS):
            if not all(same[i : i + k + 1]) or i + k >= len(same):
                break
            found.add((1 << q.GRAM_BITS) + k)
    return sorted(found)


def quality(texts, labels, c=4.0, epochs=12):
    """{id: text}, {id: label} of the rows to learn from -> {id: score}"""
    from tidelake.llm.quality import SLOTS

    ids = sorted((i for i in labels if texts.get(i) is not None), key=str)
    x = np.zeros((len(ids), SLOTS))
    for row, i in zip(x, ids, strict=True):
        row[slots(texts[i])] = 1
    y = np.array([1.0 if labels[i] else -1.0 for i in ids])
    good, bad = 1 + x[y > 0].sum(axis=0), 1 + x[y < 0].sum(axis=0)
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    z = x * ratio
    z = np.hstack([z / np.linalg.norm(z, axis=1, keepdims=True), np.ones((len(z), 1))])

    def descend(z, y):
        w, alpha, rng = np.zeros(z.shape[1]), np.zeros(len(z)), np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(len(z)):
                new = min(max(alpha[i] - (y[i] * (w @ z[i]) - 1) / (z[i] @ z[i]), 0), c)
                w += (new - alpha[i]) * y[i] * z[i]
                alpha[i] = new
        return w

    aside = np.arange(len(y)) % 5 == 0
    margin, up = z[aside] @ descend(z[~aside], y[~aside]), y[aside] > 0
    target = np.where(up, (up.sum() + 1) / (up.sum() + 2), 1 / ((~up).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v, d = p * (1 - p), target - p
        hessian = np.array([[v @ margin**2, v @ margin], [v @ margin, v.sum()]]) + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) + np.linalg.solve(hessian, [d @ margin - 1e-3 * (a - 1), d.sum() - 1e-3 * b])
    w, out = descend(z, y), {}
    for i, text in texts.items():
        own = np.zeros(SLOTS)
        own[slots(text)] = 1
        own *= ratio
        m = own @ w[:-1] / max(np.linalg.norm(own), 1e-12) + w[-1]
        out[i] = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
    return out


def cosine(x):
    x = np.array([[np.nan if c is None else c for c in v] for v in x], np.float64)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x @ x.T
