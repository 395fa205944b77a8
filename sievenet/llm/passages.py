"""Suffix-array dedup: longest-previous-factor arrays over shards of passages that may repeat.

A suffix array of everything fits no task.  Each window of a text is therefore filed under an anchor, the smallest
hash of the byte grams in it, which is the same wherever the window occurs; neighbouring
windows with one anchor make a block.  Equal blocks become one.  What shares an anchor is compared in one suffix
array: for each suffix the previous and the next one in suffix order that begin earlier give its longest earlier match.
An anchor with too many different blocks for one array is cut up by anchors of longer grams; grams as long as the
window leave only equal windows together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievenet.llm.tables import saved, sized_join, small_share_join
from sievenet.llm.words import U64, mix, signed

LENGTH = 400  # bytes of a window
GRAMS = (128, 256)  # bytes of the grams that make anchors, level by level; the last level's are as long as the window
RUN = 1024  # windows of a block at most; longer runs are cut, windows never
GROUP = 2048  # different blocks of an anchor in one suffix array
SHARD = 1 << 19  # bytes of a suffix array, about
PAIRS = 1 << 12  # suffixes compared at once
CHUNK = 1 << 21  # bytes hashed at once; a longer text is a chunk of its own

_STEP = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(31_337).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LAST = np.iinfo(np.int64).max  # stands for a missing doc_id, which comes last


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the bytes from each position on, size of them."""
    n = len(data)
    powers = np.full(n, _STEP, U64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=U64)
    total = np.zeros(n + 1, U64)
    np.cumsum(_VALUES[data] * powers, out=total[1:])
    # equal grams at other places differ by a power of the step only
    back = np.full(n - size + 1, pow(_STEP, -1, 1 << 64), U64)
    back[:1] = 1
    return mix((total[size:] - total[: n - size + 1]) * np.cumprod(back, dtype=U64))


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n = len(values) - width + 1
    if width == 1:
        return values
    rows = -(-len(values) // width)
    square = np.full(rows * width, np.iinfo(np.uint64).max, U64)
    square[: len(values)] = values
    square = square.reshape(rows, width)
    from_left = np.minimum.accumulate(square, axis=1).ravel()
    from_right = np.ascontiguousarray(np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(from_right[:n], from_left[width - 1 : width - 1 + n])


def _runs(least: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each block among the windows low .. high - 1."""
    own = least[low:high]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    lengths = np.diff(np.append(starts, len(own)))
    if lengths.max() > RUN:
        pieces = -(-lengths // RUN)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + lengths, pieces)
        starts = np.repeat(starts, pieces) + step * RUN
        lengths = np.minimum(RUN, ends - starts)
    return starts + low, lengths


def _chunks(bodies: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of the first text, bytes, and the texts' bounds in them; null counts as empty."""
    bodies = bodies.cast(pa.large_binary()).fill_null(b"")
    if not len(bodies):
        return
    _, where, data = bodies.buffers()
    bounds = np.frombuffer(where, np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(bodies):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        yield at, raw[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


_BLOCKS = "key binary, doc bigint, mark bigint, start int, at int, n int, anchor bigint, block binary, inner boolean"


def _blocks(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The blocks of each text: where, how many windows, anchor, digest, and whether the anchor's gram occurs in it more than once.

    texts: (key, doc, mark, base, body); a block's place in the order of all texts is (doc, mark, start), with start = base + at.
    """
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = [batch.column(c).to_pylist() for c in ("key", "doc", "mark", "base")]
            for first, data, bounds in _chunks(batch.column("body")):
                out: list[list] = [[] for _ in range(9)]
                if len(data) >= length:
                    hashes = _gram_hashes(data, gram)
                    least = _window_least(hashes, width)
                    raw = data.tobytes()
                for i in range(len(bounds) - 1):
                    low, high = int(bounds[i]), int(bounds[i + 1]) - length + 1
                    if high <= low:
                        continue
                    starts, counts = _runs(least, low, high)
                    anchors = least[starts]
                    key, doc, mark, base = (column[first + i] for column in named)
                    k = len(starts)
                    out[0] += [key] * k
                    out[1] += [doc] * k
                    out[2] += [mark] * k
                    out[3] += (starts - low + base).tolist()
                    out[4] += (starts - low).tolist()
                    out[5] += counts.tolist()
                    out[6] += signed(anchors).tolist()
                    for s, n, anchor in zip(starts.tolist(), counts.tolist(), anchors, strict=True):
                        out[7].append(hashlib.blake2b(raw[s : s + n + length - 1], digest_size=16).digest())
                        out[8].append(n > 1 and int(np.count_nonzero(hashes[s : s + n + width - 1] == anchor)) > 1)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["key", "doc", "mark", "start", "at", "n", "anchor", "block", "inner"])

    return texts.mapInArrow(run, _BLOCKS)


def suffix_order(data: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts, in the order of the depth bytes from each on; equal ones by place."""
    keys = [data[i : i + depth] for i in starts.tolist()]
    return starts[sorted(range(len(keys)), key=keys.__getitem__)]


def _common(data: np.ndarray, i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common beginning of the depth bytes from i and from j on."""
    windows = np.lib.stride_tricks.sliding_window_view(data, depth)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        differ = windows[i[at : at + PAIRS]] != windows[j[at : at + PAIRS]]
        first = differ.argmax(axis=1)
        out[at : at + PAIRS] = np.where(differ[np.arange(len(first)), first], first, depth)
    return out


def previous_factors(data: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of starts (ascending): its longest match with one that begins earlier, up to depth, and where that begins."""
    order = suffix_order(data, starts, depth)
    letters = np.frombuffer(data, np.uint8)
    m = len(order)
    best, source = np.zeros(m, np.int64), np.full(m, -1, np.int64)
    for step in (-1, 1):
        near = np.arange(m) + step
        open_ = np.flatnonzero((near >= 0) & (near < m))
        while len(open_):  # past those that begin later, and past all that they have passed
            open_ = open_[order[near[open_]] > order[open_]]
            near[open_] = near[near[open_]]
            open_ = open_[(near[open_] >= 0) & (near[open_] < m)]
        at = np.flatnonzero((near >= 0) & (near < m))
        found = _common(letters, order[at], order[near[at]], depth)
        longer = found > best[at]
        best[at[longer]], source[at[longer]] = found[longer], order[near[at[longer]]]
    back = np.argsort(order)
    return best[back], source[back]


def _spans(flags: np.ndarray) -> list[int]:
    """Bounds of the runs of set flags, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist()


def compare(passages: list[bytes], length: int) -> list[tuple[list[int], list[int]]]:
    """Per passage, in order: the windows that occur elsewhere, and those that occur earlier, as spans of their first bytes."""
    data = b"".join(passages)
    ends = np.cumsum([len(p) for p in passages])
    starts = np.concatenate([np.arange(end - len(p), end - length + 1) for p, end in zip(passages, ends.tolist(), strict=True)])
    factors, sources = previous_factors(data, starts, length)
    later = np.zeros(len(data), bool)
    later[starts] = factors >= length
    every = later.copy()
    every[sources[factors >= length]] = True
    out, at = [], 0
    for p in passages:
        end = at + len(p) - length + 1
        out.append((_spans(every[at:end]), _spans(later[at:end])))
        at += len(p)
    return out


def _compared(blocks: DataFrame, length: int) -> DataFrame:
    """block, every and later of blocks (anchor, block, doc, mark, start, body), shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[bytes, bytes]] = []
        size, anchor, known = 0, None, set()

        def result() -> pa.RecordBatch:
            found = compare([body for _, body in shard], length) if shard else []
            columns = [pa.array([b for b, _ in shard], pa.binary()), pa.array([e for e, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "every", "later"])

        for batch in batches:
            for own, block, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "body")), strict=True):
                if own != anchor:
                    if size >= SHARD:
                        yield result()
                        shard, size = [], 0
                    anchor, known = own, set()
                if block not in known:  # repeated rows bring a block more than once
                    known.add(block)
                    shard.append((block, body))
                    size += len(body)
        yield result()

    rows = blocks.repartition("anchor").sortWithinPartitions("anchor", "doc", "mark", "start")
    return rows.mapInArrow(run, "block binary, every array<int>, later array<int>")


def _fetched(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """asked (anchor, block, n, place) with the bytes of each block."""
    wanted = saved(asked.groupBy(F.col("place.key").alias("key"), F.col("place.doc").alias("doc")).agg(F.collect_list(F.struct("place.at", "n", "anchor", "block")).alias("wanted")), "wanted")
    texts = sized_join(texts, wanted.select("key", "doc"), ["key", "doc"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, mark, base, body, blocks in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "base", "body", "wanted")), strict=True):
                for b in blocks:
                    at, end = b["at"], b["at"] + b["n"] + length - 1
                    out.append((b["anchor"], b["block"], doc, mark, base + at, body[at:end]))
                    size += end - at
                    if size > CHUNK:
                        yield _fetched_rows(out)
                        out, size = [], 0
            yield _fetched_rows(out)

    return texts.join(wanted, ["key", "doc"]).mapInArrow(run, "anchor bigint, block binary, doc bigint, mark bigint, start int, body binary")


def _fetched_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "block", "doc", "mark", "start", "body"])


def _windows(texts: DataFrame, length: int, grams: tuple[int, ...], group: int) -> DataFrame:
    """key, doc, at, every and later: per block with repeated windows, which of its windows occur elsewhere and which occur earlier."""
    blocks = saved(_blocks(texts, length, grams[0]), "blocks")
    shared = saved(blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.max("inner").alias("inner")).where("k > 1 or inner").select("anchor"), "shared")
    place = F.min(F.struct("doc", "mark", "start", "key", "at")).alias("place")
    distinct = sized_join(blocks, shared, "anchor", "left_semi").groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max("inner").alias("inner"), place)
    distinct = saved(distinct, "distinct")
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.max("inner").alias("inner")).where("m > 1 or inner").select("anchor", "m")
    asked = saved(distinct.select("anchor", "block", "n", "place").join(several, "anchor"), "asked")
    if len(grams) == 1:  # windows of an anchor are equal here
        found = _compared(_fetched(texts, asked, length), length)
    else:
        found = _compared(_fetched(texts, asked.where(F.col("m") <= group), length), length)
        many = asked.where(F.col("m") > group)
        if not many.isEmpty():
            large = saved(_fetched(texts, many, length).select(F.col("block").alias("key"), "doc", "mark", F.col("start").alias("base"), "body").dropDuplicates(["key"]), "large")
            inner = _windows(large, length, grams[1:], group)
            moved = lambda c: F.transform(c, lambda x: x + F.col("at"))
            found = found.unionByName(inner.groupBy(F.col("key").alias("block")).agg(F.flatten(F.collect_list(moved("every"))).alias("every"), F.flatten(F.collect_list(moved("later"))).alias("later")))
    whole = F.array(F.lit(0), F.col("n"))
    flags = distinct.select("block", "k", "n", "place").join(found, "block", "left").where("k > 1 or size(every) > 0")
    flags = saved(flags.select("block", "k", F.when(F.col("k") > 1, whole).otherwise(F.col("every")).alias("every"), F.coalesce("later", F.array().cast("array<int>")).alias("later"), "place"), "flags")
    hits = small_share_join(blocks.select("key", "doc", "mark", "start", "at", "n", "block"), flags, "block", "k").where("place is not null")
    first = (F.col("doc") == F.col("place.doc")) & (F.col("mark") == F.col("place.mark")) & (F.col("start") == F.col("place.start"))
    return hits.select("key", "doc", "at", "every", F.when(first, F.col("later")).otherwise(whole).alias("later"))


def repeated_passages(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, spans (low, high) of removed bytes and kept, the other bytes, of each row of docs.

    A window is that many consecutive bytes of one text in UTF-8.  Windows that occur earlier, in a row with a smaller
    doc_id or further left in the same one, are removed; with keep_first False those that occur anywhere else are,
    the first one too.  Windows are judged on the input and may overlap.

    A null, empty or short text has no window and keeps its bytes; kept of a null is empty.  Rows without a doc_id come
    last.  Repeated texts are copies; rows that repeat both doc_id and text are one document for keep_first, and copies of each
    other otherwise.  Texts of any length are read whole.  Only doc_id and text are used.
    """
    grams = tuple(sorted({min(g, length) for g in (*GRAMS, length)}))
    key = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc"), key.alias("key"), F.col("text").cast("binary").alias("body"))
    # among rows with one doc_id, texts are ordered by a hash
    texts = rows.where(F.octet_length("body") >= length).select("key", "doc", F.xxhash64("body").alias("mark"), F.lit(0).alias("base"), "body")
    taken = F.col("later" if keep_first else "every")
    hits = _windows(texts, length, grams, group).select("key", "doc", F.struct("at", taken.alias("spans")).alias("hit")).where("size(hit.spans) > 0")
    hits = saved(hits.groupBy("key", "doc").agg(F.collect_list("hit").alias("hits")), "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for body, found in zip(batch.column("body").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                body = body or b""
                gone = np.zeros(len(body) + 1, np.int32)
                for hit in found or ():
                    bounds = np.array(hit["spans"], np.int64) + hit["at"]
                    np.add.at(gone, bounds[0::2], 1)
                    np.add.at(gone, bounds[1::2] + length - 1, -1)
                own = _spans(np.cumsum(gone[:-1]) > 0)
                edges = [0, *own, len(body)]
                sizes.append(len(body))
                spans.append([{"low": a, "high": b} for a, b in zip(own[0::2], own[1::2], strict=True)])
                kept.append(b"".join(body[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    doc_id = rows.schema["doc_id"].dataType.simpleString()
    judged = rows.join(hits, ["key", "doc"], "left").select("doc_id", "body", "hits")
    return judged.mapInArrow(run, f"doc_id {doc_id}, n_bytes bigint, spans array<struct<low:int,high:int>>, kept binary")


def report(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs."""
    found = repeated_passages(docs, length, keep_first, group)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["high"] - s["low"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
