"""Cross-tokenizer alignment: where the tokens of two public tokenizers end together, text by text.

Texts are shuffled by their whole text, so each distinct one is tokenised and aligned once; a pair of
token ids counts for as many documents as hold the text.  Measures go back to the documents by SHA-256.
Tokenizers are given as files: a byte-level BPE (vocabulary and merges as JSON) and a piece BPE with byte fallback.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievenet.llm.tables import saved, slices, small_share_join

FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.json"
PIECE_BPE = f"{FOLDER}/piece_bpe_32k.model"

# Fixed value: the pattern that parts a text before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PART = 1 << 16  # characters after which a text is cut at the next blank between words, which no token crosses
SLICE = 1 << 20  # bytes of text aligned at once
DENSE = 1 << 12  # links of a group from which equal ids are counted before they are paired
_BLANK = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        import sentencepiece
        import tiktoken

        given, letters = json.loads(byte_bpe), _byte_letters()
        special = {t["content"] for t in given.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in word): i for word, i in given["model"]["vocab"].items() if word not in special}
        # merging by id is merging by rank only if ids follow the list of merges
        merged = [ranks[bytes(letters[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in given["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the byte-level vocabulary isn't numbered in the order of its merges")
        self.one = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.two = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        self.bytes_one = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            self.bytes_one[i] = word
        self.bytes_two = [self._piece(self.two.id_to_piece(i)) for i in range(self.two.get_piece_size())]
        self.lengths_one = np.array([len(b) for b in self.bytes_one], np.int64)
        self.lengths_two = np.array([len(b) for b in self.bytes_two], np.int64)
        # each id as text, followed by what parts it from the next
        self.named_one = [f"{i}{c}".encode() for c in ",|" for i in range(len(self.bytes_one))]
        self.named_two = [f"{i}{c}".encode() for c in ",;" for i in range(len(self.bytes_two))]

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Both token lists of space + text; None where the joined bytes of one differ from that."""
        try:
            whole = text.decode()
        except UnicodeDecodeError:
            return None
        cuts, at = [0], 0
        while at + PART < len(whole) and (found := _BLANK.search(whole, at + PART)):
            at = found.end()
            cuts.append(at)
        parts = [whole] if len(cuts) == 1 else [whole[a : b - 1] for a, b in zip(cuts, [*cuts[1:], len(whole) + 1])]
        one = np.concatenate([self.one.encode_to_numpy(" " + part, disallowed_special=()) for part in parts])
        found = self.two.encode(parts, num_threads=1)
        two = found[0] if len(found) == 1 else [t for own in found for t in own]
        # a byte-level BPE gives back all bytes of what it reads; the other one may change the text
        if int(self.lengths_one[one].sum()) != len(text) + 1 or b"".join(map(self.bytes_two.__getitem__, two)) != b" " + text:
            return None
        two = np.array(two, np.int64)
        return one, two


def _spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of counts, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _linked(g1: np.ndarray, a: np.ndarray, n1: np.ndarray, b: np.ndarray, n2: np.ndarray, of_group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (text, a, b) of linked pairs, and how often each.  of_group: the text's part of the key."""
    first = np.cumsum(n2) - n2
    thin = n1 * n2 < DENSE
    mine = thin[g1]
    often = np.where(mine, n2[g1], 0)
    left = np.repeat(np.arange(len(a)), often)
    right = first[g1[left]] + _spread(often)
    keys, counts = np.unique(of_group[g1[left]] + a[left] * width + b[right], return_counts=True)
    if thin.all():
        return keys, counts
    more, weights = [keys], [counts]
    start = np.cumsum(n1) - n1
    for g in np.flatnonzero(~thin):
        x, nx = np.unique(a[start[g] : start[g] + n1[g]], return_counts=True)
        y, ny = np.unique(b[first[g] : first[g] + n2[g]], return_counts=True)
        more.append((of_group[g] + x[:, None] * width + y).ravel())
        weights.append((nx[:, None] * ny).ravel())
    keys, back = np.unique(np.concatenate(more), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, back, np.concatenate(weights))
    return keys, total


def align(texts: list[bytes], tokenizers: Tokenizers) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, the groups as text, and the linked pairs (a * pieces + b) with how often each, per text."""
    width = len(tokenizers.bytes_two)
    span = len(tokenizers.bytes_one) * width
    found = [tokenizers.encode(t) if t else None for t in texts]
    some = [f for f in found if f is not None]
    n_a = np.array([len(f[0]) for f in some], np.int64)
    n_b = np.array([len(f[1]) for f in some], np.int64)
    a, b = (np.concatenate([f[k] for f in some]).astype(np.int64) if some else np.zeros(0, np.int64) for k in (0, 1))
    end_a, end_b = np.cumsum(tokenizers.lengths_one[a]), np.cumsum(tokenizers.lengths_two[b])
    shared = np.intersect1d(end_a, end_b, assume_unique=True)
    g_a, g_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
    n1, n2 = np.bincount(g_a, minlength=len(shared)), np.bincount(g_b, minlength=len(shared))
    text_ends = np.searchsorted(shared, end_a[np.cumsum(n_a) - 1]) + 1 if some else np.zeros(0, np.int64)
    groups = np.diff(text_ends, prepend=0)
    links = np.add.reduceat(n1 * n2, text_ends - groups) if some else groups
    of_group = np.repeat(np.arange(len(some)), groups) * span
    keys, times = _linked(g_a, a, n1, b, n2, of_group, width)
    key_ends = np.searchsorted(keys, np.arange(1, len(some) + 1) * span)
    # tokens in the order of their groups, A's before B's, each with the sign that follows
    last_a, last_b = np.diff(g_a, append=-1) != 0, np.diff(g_b, append=-1) != 0
    names = np.empty(len(a) + len(b), object)
    names[np.arange(len(a)) + (np.cumsum(n2) - n2)[g_a]] = list(map(tokenizers.named_one.__getitem__, (a + last_a * len(tokenizers.bytes_one)).tolist()))
    names[np.arange(len(b)) + np.cumsum(n1)[g_b]] = list(map(tokenizers.named_two.__getitem__, (b + last_b * width).tolist()))
    names = names.tolist()
    ends = np.cumsum(n_a + n_b)
    out, at = [], 0
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        low, high = (key_ends[at - 1] if at else 0), key_ends[at]
        text = b"".join(names[ends[at - 1] if at else 0 : ends[at]])[:-1]
        out.append((int(n_a[at]), int(n_b[at]), int(groups[at]), int(links[at]), text, keys[low:high] - at * span, times[low:high]))
        at += 1
    return out


def _loaded(files: list[bytes]) -> Tokenizers:
    """The tokenizers, once a Python worker: this module travels by value and is new in every task, so they are kept by another name."""
    kept = sys.modules.setdefault("sievenet_worker_tokenizers", types.ModuleType("sievenet_worker_tokenizers")).__dict__
    key = hashlib.sha256(b"".join(files)).digest()
    if kept.get("key") != key:
        kept.update(key=key, tokenizers=Tokenizers(*files))
    return kept["tokenizers"]


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    now, size = [], 0
    for t in texts:
        if now and size + len(t) > SLICE:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


_ALIGNED = "mark binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups binary, pairs array<bigint>, times array<int>"


def aligned(texts: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, keep_groups: bool = True) -> DataFrame:
    """One row per row (mark, copies, text): token counts, the groups, and the linked id pairs (a * pieces + b) with how often each.

    groups reads `a1,a2|b1;a3|b2,b3`; with keep_groups False it is their SHA-256.  Without tokens it is empty.
    """
    spark = texts.sparkSession
    files = spark.sparkContext.broadcast([open(path, "rb").read() for path in (byte_bpe, piece_bpe)])  # a vocabulary each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _loaded(files.value)
        for batch in batches:
            at = 0
            for some in _slices(batch.column("text").cast(pa.large_binary()).to_pylist()):
                rows = align(some, tokenizers)
                n = len(rows)
                groups = [r[4] if keep_groups else hashlib.sha256(r[4]).digest() if r[4] else b"" for r in rows]
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                lists = [_lists([r[5] for r in rows], pa.int64()), _lists([r[6] for r in rows], pa.int32())]
                columns = [batch.column("mark").slice(at, n), batch.column("copies").slice(at, n), *numbers, pa.array(groups, pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["mark", "copies", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                at += n

    return texts.select("mark", "copies", "text").mapInArrow(run, _ALIGNED)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """mark (SHA-256), copies and text of each distinct text that isn't null or empty: one shuffle by the whole text, combined before it."""
    counted = docs.where("text is not null and text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return counted.select(F.unhex(F.sha2("text", 256)).alias("mark"), "copies", "text")


def pair_counts(links: DataFrame, pieces: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (n is the highest of its A id) of each linked id pair."""
    counted = saved(links.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n")), "pairs")
    a = F.floor(F.col("pair") / pieces)
    highest = counted.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return saved(counted.withColumn("a", a).join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")


def measures(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs.

    Both tokenizers read a space and the text.  Byte offsets at which tokens of both end cut the tokens
    into groups; every A token links with every B token of its group.  A pair of ids counts in how many rows it is linked
    somewhere; n_best are links whose count is the highest of their A id, ties included, count_sum adds the counts of all links.

    A text that is null, empty, not UTF-8, or that a tokenizer can't give back byte for byte has zeros and
    an empty groups_sha256.  Long texts are tokenised in parts, cut at single blanks between words, which no
    token crosses; one without any is read whole.  Repeated rows and ids give a row each.  Only doc_id and text are used.
    """
    texts = distinct_texts(docs.select("text"))
    found = saved(aligned(texts, byte_bpe, piece_bpe, keep_groups=False).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pieces = _pieces(piece_bpe)
    links = found.where("n_links > 0").select("row", "copies", "pairs", "times")
    counts = pair_counts(links, pieces)
    single = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("k"))
    sums = None
    for part in slices(counts, "pair", 64):  # counts are broadcast in slices of bounded size; the links stay where they are
        of = part(single).join(F.broadcast(part(counts)), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
        sums = of if sums is None else sums.unionByName(of)
    sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    per_text = saved(found.join(sums, "row", "left").select("mark", "copies", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.lower(F.hex("groups")).alias("groups_sha256")), "measures")
    rows = saved(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("mark")), "marks")
    joined = small_share_join(rows, per_text, "mark", "copies")
    numbers = [F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return joined.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def _pieces(piece_bpe: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe).get_piece_size()
