"""Substring dedup and words: all texts of a chunk at once, with what each text gives alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sievenet.llm import substrings
from sievenet.llm.words import PLAIN_WORDS, chunks


class Rows:
    """Stands for a table of which each batch is handed to the function of mapInArrow."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):  # noqa: N802
        return pa.Table.from_batches(list(run(iter(self.batches))))


def some_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé\u3000") for _ in range(rng.randint(1, 2)))
    texts = [None, "", " ", "a", " a", "a ", "\t a\n\nb ", "b", "a b " * 60, "x y z"]
    return texts + [rng.choice(["", " ", "\r\n"]) + rng.choice([" ", "  "]).join(word() for _ in range(rng.randint(0, 60))) + rng.choice(["", " "]) for _ in range(300)]


def batch_of(texts):
    return pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})


def test_kept_words_are_joined():
    texts, rng = some_texts(1), np.random.default_rng(1)
    for share in (0, 0.4, 1):
        for size in (64, 1 << 20):
            for chunk in chunks(pa.array(texts), PLAIN_WORDS, size):
                kept = rng.random(len(chunk.hashes)) < share
                want = [b" ".join(w for w, k in zip(chunk.string(a, b), kept[a:b], strict=True) if k).decode() for _, a, b in chunk.texts()]
                assert chunk.joined(kept).to_pylist() == want


@pytest.mark.parametrize("window", [1, 2, 3, 13])
def test_blocks_of_a_chunk(window):
    """Windows of one text with one anchor, in runs cut at RUN; a chunk of many texts gives what each text gives alone."""
    texts = some_texts(window)
    alone = [[(i, *row) for chunk in chunks(pa.array([t], pa.string()), PLAIN_WORDS) for row in found(chunk, window)] for i, t in enumerate(texts)]
    (chunk,) = chunks(pa.array(texts), PLAIN_WORDS)
    blocks = substrings._Blocks(chunk, window)
    own = [(int(t), *row) for t, row in zip(blocks.texts, found(chunk, window), strict=True)]
    assert own == [row for rows in alone for row in rows]
    assert sum(blocks.lengths) == sum(max(0, b - a - window + 1) for _, a, b in chunk.texts()) and max(blocks.lengths) <= substrings.RUN


def found(chunk, window):
    blocks = substrings._Blocks(chunk, window)
    hashes = substrings._block_hashes(chunk.hashes, blocks.starts, blocks.lengths, window)
    return [(int(s - chunk.bounds[t]), int(n), int(a), int(h)) for s, t, n, a, h in zip(blocks.starts, blocks.texts, blocks.lengths, blocks.anchors, hashes, strict=True)]


def test_a_chunk_is_hashed_at_once(monkeypatch):
    """Not text by text: hundreds of short texts take a few calls."""
    texts = some_texts(2)
    calls, real = [], substrings._block_hashes
    monkeypatch.setattr(substrings, "_block_hashes", lambda *a: calls.append(1) or real(*a))
    anchors = {r["doc_id"]: r["anchors"] for r in substrings._anchor_lists(Rows(batch_of(texts)), 13).to_pylist()}
    given = batch_of(texts).append_column("anchors", pa.array([anchors.get(i) for i in range(len(texts))], pa.list_(pa.int64())))
    shared = substrings._shared_blocks(Rows(given), 13, True)
    assert {i for i in shared["doc_id"].to_pylist()} == set(anchors) and len(anchors) > 200
    assert len(calls) == 1
