"""Straightforward versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def decontaminate(docs, benchmark, window=13):
    grams = {}
    for item, text in benchmark:
        own = TEST_WORD.findall(low(text))
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            grams.setdefault(tuple(own[k : k + n]), set()).update([] if item is None else [str(item)])
    sizes, out = {len(g) for g in grams}, []
    for doc, text in docs:
        own, hit, items = TEST_WORD.findall(low(text)), set(), set()
        for n in sizes:
            for k in range(len(own) - n + 1):
                if (g := tuple(own[k : k + n])) in grams:
                    hit.update(range(k, k + n))
                    items |= grams[g]
        out.append((doc, len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)))
    return out


def shingles(text, n):
    own = SPACED.findall(low(text))
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)] if own else [])


def jaccard(docs, n=3, numerator=90, denominator=100):
    sets = {d: shingles(t, n) for d, t in docs if d is not None}
    union = Union(sets)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and denominator * both >= numerator * (len(sets[a]) + len(sets[b]) - both):
            union.join(a, b)
    return [(d, len(shingles(t, n)), None if d is None else union.root(d)) for d, t in docs]


def substrings(docs, window=13):
    words = [(d, SPACED.findall(t or "")) for d, t in docs]
    least = {}
    for d, own in words:
        for k in range(len(own) - window + 1):
            if d is not None:
                g = tuple(own[k : k + window])
                least[g] = min(least.get(g, d), d)
    out = []
    for d, own in words:
        gone = set()
        for k in range(len(own) - window + 1):
            if d is not None and least[tuple(own[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((d, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def _hash(data: bytes, seed: int) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def lines(docs, spacing=4, least=2):
    """Line chunks by a rolling hash over two line hashes, as Spark's xxhash64 has it."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chunks = {}
    for d, text in docs:
        own = [] if text is None else text.split("\n")
        hashes = [signed(_hash(line.encode(), 42)) for line in own]
        start = 0
        for k in range(len(own)):
            rolled = _hash(struct.pack("<q", hashes[k]), _hash(struct.pack("<q", hashes[k - 1] if k else 0), 42))
            if k == len(own) - 1 or signed(rolled) % spacing == 0:
                if k - start + 1 >= least and d is not None:
                    chunks.setdefault(tuple(own[start : k + 1]), []).append((d, start, k - start + 1))
                start = k + 1
    gone = {}
    for spots in chunks.values():
        for d, start, size in spots:
            if (d, start) != min(spots)[:2]:
                gone.setdefault(d, set()).update(range(start, start + size))
    out = []
    for d, text in docs:
        if text is None:
            out.append((d, 0, 0, None))
            continue
        own, cut = text.split("\n"), gone.get(d, ())
        kept = "\n".join(line for k, line in enumerate(own) if k not in cut)
        out.append((d, len(own), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def vectors(rows, threshold=0.98):
    fit = lambda v, label: label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    union, links = Union([i for i, _, _ in rows]), {i: 0 for i, _, _ in rows}
    for (a, v, x), (b, w, y) in itertools.combinations(rows, 2):
        if fit(v, x) and fit(w, y) and x == y and len(v) == len(w):
            v, w = np.float32(v).astype(float), np.float32(w).astype(float)
            if v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                union.join(a, b)
                links[a] += 1
                links[b] += 1
    return [(i, links[i], union.root(i), union.root(i) == i) for i, _, _ in rows]


def warc(pages, least=0):
    payloads = [(i, (html or "").encode()) for i, _, html in pages]
    first = {}
    for i, p in payloads:
        if i is not None:
            first[p] = max(first.get(p, i), i)
    out = []
    for i, p in payloads:
        again = i is not None and len(p) >= least and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Target of each source of {source: size}."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over
