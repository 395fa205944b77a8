"""Suffix-array dedup against every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from sievenet.llm import passages


def brute(docs, length, keep_first):
    rows = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    before, out = set(), []
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        doc_id, body = rows[k]
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            window = body[i : i + length]
            if (window in before) if keep_first else seen[window] > 1:
                gone[i : i + length] = b"\1" * length
            before.add(window)
        kept = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    assert frame.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(map(tuple, frame.collect()), key=str)


def some_docs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    common = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(5)]
    docs = [(1, None), (2, ""), (3, "a" * 500), (4, "ab" * 300 + "x" * 39), (5, "a" * 39), (None, "x ".join(common)), (9, "q" * 40 + "a" * 60)]
    for i in range(50):
        parts = [rng.choice(common) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        docs.append((10 + i, ". ".join(parts)))
    return docs + [(100 + i, docs[20][1]) for i in range(5)]


@pytest.mark.parametrize("run, group", [(1024, 2048), (16, 2)])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_brute_force(spark, monkeypatch, run, group, keep_first):
    """Nulls, periodic texts, copies, matches in one text; anchors with many blocks go down all levels."""
    monkeypatch.setattr(passages, "GRAMS", (12, 24))
    monkeypatch.setattr(passages, "RUN", run)
    docs = some_docs(run)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as anchor", "2 as block", "text as key", "3 as hits")
    assert found(passages.report(frame, 40, keep_first, group)) == brute(docs, 40, keep_first)


def test_repeated_rows(spark):
    """Rows that repeat id and text are copies, but one document where the first one is kept."""
    docs = [(1, "x" + "abcdefgh" * 100), (1, "x" + "abcdefgh" * 100), (2, "short")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(passages.report(frame)) == brute(docs, 400, False)
    both = found(passages.report(frame, keep_first=True))
    assert [r[2] for r in both] == [792, 792, 0]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(passages.report(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 400, False)


def test_empty_table(spark):
    assert found(passages.report(spark.createDataFrame([], "doc_id bigint, text string"))) == []


def test_previous_factors():
    """Longest previous factors and their sources, against all pairs."""
    rng = random.Random(5)
    data = "".join(rng.choice("ab") for _ in range(400)).encode() + b"ab" * 30
    starts = np.array(sorted(rng.sample(range(len(data) - 32), 200)))
    factors, sources = passages.previous_factors(data, starts, 32)
    common = lambda i, j: next((n for n in range(32) if data[i + n] != data[j + n]), 32)
    for k, i in enumerate(starts.tolist()):
        want = max((common(i, j) for j in starts[:k].tolist()), default=0)
        assert factors[k] == want and (not want or common(i, int(sources[k])) == want and sources[k] < i)
