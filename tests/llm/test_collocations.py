"""Collocations against a straightforward version: small thresholds, blocks, and joins by shuffle."""

import random
from collections import Counter, defaultdict
from math import inf

import pytest

from sievenet.llm import collocations

WORDS = ["a", "B", "b", "é", "x1", " ", "nul\x00", "\x1c", "Z-z"]


def brute(docs, support, longest, best):
    counts, totals = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            lowered = lowered.replace(end, "\n")
        for piece in lowered.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    rows = defaultdict(list)
    candidates = {(lang, w): a for (lang, w), a in counts.items() if len(w) > 1 and a >= support}
    for (lang, w), a in candidates.items():
        held = any(other == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (other, v), b in candidates.items())
        if held:
            continue
        low = (inf,)
        for k in range(1, len(w)):
            l, r = counts[lang, w[:k]], counts[lang, w[k:]]
            low = min(low, (1000 * a * totals[lang] // (l * r), k, l, r))
        rows[lang].append((-low[0], -a, " ".join(w).encode(), low[2], low[3]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:best]))


def mine(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, frame.collect()))


def some_docs(seed):
    rng = random.Random(seed)
    sentence = lambda: rng.choice([" ", "  ", "\t"]).join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
    docs = [(rng.choice(["en", "fr", None, "und", ""]), rng.choice(".,;:!?\n\r\x0b").join(sentence() for _ in range(rng.randint(0, 5)))) for _ in range(60)]
    return [*docs, ("en", None), (None, ""), ("en", "a b " * 400), docs[0], docs[0]]


@pytest.mark.parametrize("block, limit", [(1 << 14, 1 << 25), (7, 1 << 25), (7, 0)])
def test_against_brute_force(spark, monkeypatch, block, limit):
    """Broadcast and shuffled groups, and phrases that run from one block into the next."""
    monkeypatch.setattr(collocations, "BLOCK", block)
    docs = some_docs(block)
    frame = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 as id", "2 as n", "3 as block", "text as word")
    assert mine(collocations.collocations(frame, 3, 5, 40, limit)) == brute(docs, 3, 5, 40)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert mine(collocations.collocations(none)) == []
    assert mine(collocations.collocations(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string"), 1)) == []


def test_scores_are_exact(spark):
    a, n, l, r = 3_000_000_007, 9_000_000_000_019, 5_000_000_003, 4_000_000_001
    row = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint")
    whole = collocations.whole
    assert row.select(collocations.score(whole("a"), whole("n"), whole("l"), whole("r"))).first()[0] == 1000 * a * n // (l * r)
