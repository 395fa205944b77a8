"""Cross-tokenizer alignment against a straightforward version with other tokenizer classes."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
import sentencepiece
from conftest import SF
from tokenizers import Tokenizer

from sievenet.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TRICKY = [
    (1, "Hello wörld  <|endoftext|> a▁b"),
    (2, None),
    (3, ""),
    (4, "日本語のテキスト、漢字 🎉🎉 \x00 nul\ttab\n\n x"),
    (4, "Hello wörld"),
    (None, "Hello wörld"),
    (6, "a" * 3000 + " " + "ー" * 500 + " the end " * 20000),
    (7, " leading  and trailing "),
    (8, "<s> </s> <unk> <0x41> we'll DON'T"),
    (9, " nbsp　x ﬁ ① \x1c\x85 ab"),
]


def brute(docs):
    one = Tokenizer.from_file(alignment.BYTE_BPE)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letters = alignment._byte_letters()
    groups = []
    for _, text in docs:
        groups.append(None)
        if not text:
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        of_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        of_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
        if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            continue
        ends = [list(accumulate(map(len, of))) for of in (of_a, of_b)]
        found, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = [], []
            while i < len(a) and ends[0][i] <= end:
                x.append(a[i])
                i += 1
            while j < len(b) and ends[1][j] <= end:
                y.append(b[j])
                j += 1
            found.append((x, y))
        groups[-1] = found
    counts = Counter(p for g in groups if g for p in {(i, j) for x, y in g for i in x for j in y})
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    rows = []
    for (doc_id, _), g in zip(docs, groups, strict=True):
        if not g:
            rows.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(i, j) for x, y in g for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(counts[p] == top[p[0]] for p in links)
        rows.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), best, sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows, key=str)


def found(frame):
    rows = frame.collect()
    assert frame.columns == COLUMNS
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("part, dense", [(1 << 16, 1 << 12), (50, 4)])
def test_tricky_texts(spark, monkeypatch, part, dense):
    """Nulls, copies, control characters, strings of special tokens, very long texts, parts and dense groups."""
    monkeypatch.setattr(alignment, "PART", part)
    monkeypatch.setattr(alignment, "DENSE", dense)
    docs = spark.createDataFrame(TRICKY, "doc_id bigint, text string").selectExpr("*", "text as mark", "1 as row", "2 as pairs", "3 as copies")
    assert found(alignment.measures(docs)) == brute(TRICKY)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(alignment.measures(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_counts_in_slices(spark, monkeypatch):
    from sievenet.llm import tables

    docs = spark.createDataFrame(TRICKY, "doc_id bigint, text string")
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 4000)
    assert found(alignment.measures(docs)) == brute(TRICKY)


def test_empty_table_and_groups(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert found(alignment.measures(none)) == []
    texts = alignment.distinct_texts(spark.createDataFrame([(1, "ab"), (2, "ab")], "doc_id bigint, text string"))
    row = alignment.aligned(texts).first()
    assert (row.copies, bytes(row.groups).count(b"|")) == (2, row.n_groups)
