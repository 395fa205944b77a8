"""Substring dedup: suffix automata over shards of repeated passages, and the texts matched against them.

Sending every automaton to every document costs shards times documents.  Here each
window of words is filed under an anchor, the smallest hash of its word 5-grams, which is
the same wherever the window occurs.  Passages whose anchor occurs in one document
only can't repeat.  The rest are cut by anchor into blocks; equal blocks become one,
and a shard is what shares an anchor.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievenet.llm.tables import saved, small_enough
from sievenet.llm.words import PLAIN_WORDS, U64, Chunk, chunks, mix, powers, signed

WINDOW = 13
ANCHOR = 5  # words of an anchor
RUN = 32  # windows of a block at most; longer runs are cut, windows never
SHARD = 4096  # blocks that share an anchor and are matched in one automaton; more are compared window by window

NEVER = np.iinfo(np.int64).max
CHUNK = 1 << 18  # bytes hashed at once: their numbers fit a core's cache
BYTES = 6  # of a word's hash in a block: blocks are compared only where their anchors' 64 bits agree


def _packed(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.BinaryArray:
    """counts words' hashes from each of starts on, cut to BYTES."""
    ends = np.cumsum(counts)
    at = np.arange(counts.sum()) + np.repeat(starts - (ends - counts), counts)
    cut = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :BYTES])
    offsets = np.concatenate([[0], ends * BYTES]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(cut[at])])


def _unpacked(words: bytes) -> np.ndarray:
    own = np.frombuffer(words, np.uint8).reshape(-1, BYTES)
    return np.concatenate([own, np.zeros((len(own), 8 - BYTES), np.uint8)], 1).view(U64).ravel()


class SuffixAutomaton:
    """Substrings of several sequences, with the smallest label of a sequence that holds each."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [NEVER]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.low.append(NEVER)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        made = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = made
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        made = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[made] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return made

    def add(self, sequence: list[int], label: int) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.low[last] = min(self.low[last], label)

    def finish(self) -> None:
        """Labels reach every substring; add nothing afterwards."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            self.low[up] = min(self.low[up], self.low[v])

    def lows(self, sequence: list[int], size: int) -> list[int]:
        """For each window of this size: the smallest label of a sequence that holds it, or NEVER.

        Follows the matching statistics: the longest suffix read so far that occurs.
        """
        v = matched = 0
        out = []
        for i, c in enumerate(sequence):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            if c in self.next[v]:
                v = self.next[v][c]
                matched += 1
            if i + 1 < size:
                continue
            if matched < size:
                out.append(NEVER)
                continue
            u = v
            while self.length[self.link[u]] >= size:
                u = self.link[u]
            out.append(self.low[u])
        return out


def _fingerprints(chunk: Chunk) -> np.ndarray:
    """One number for the word sequence of each text."""
    count = np.diff(chunk.bounds)
    where = mix((np.arange(len(chunk.hashes)) - np.repeat(chunk.bounds[:-1], count)).astype(U64))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(chunk.hashes ^ where), dtype=U64)])
    return signed(mix(total[chunk.bounds[1:]] - total[chunk.bounds[:-1]] + count.astype(U64)))


def _anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window; hashes: of the 5-grams (or of shorter grams if windows are short)."""
    spread = window - min(ANCHOR, window) + 1
    width, out = 1, hashes
    while width < spread:  # the least of width grams makes that of up to twice as many
        step = min(width, spread - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


class _Blocks:
    """The blocks of a chunk: runs of windows of one text with one anchor, cut at RUN.

    starts: first word of each; lengths: its windows; texts: place of its text in the chunk; anchors.
    """

    def __init__(self, chunk: Chunk, window: int):
        whole = np.flatnonzero(chunk.whole(window))
        every = _anchors(chunk.grams(min(ANCHOR, window)), window)[whole] if len(whole) else np.zeros(0, U64)
        owners = chunk.owners()[whole]
        new = np.ones(len(whole), bool)
        new[1:] = (every[1:] != every[:-1]) | (owners[1:] != owners[:-1])
        at = np.flatnonzero(new)
        lengths = np.diff(np.append(at, len(whole)))
        if len(at) and lengths.max() > RUN:
            pieces = -(-lengths // RUN)
            ends = np.repeat(at + lengths, pieces)
            at = np.repeat(at, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
            lengths = np.minimum(RUN, ends - at)
        self.starts, self.lengths, self.texts, self.anchors = whole[at], lengths, owners[at], every[at]

    def only(self, which: np.ndarray) -> None:
        self.starts, self.lengths, self.texts, self.anchors = self.starts[which], self.lengths[which], self.texts[which], self.anchors[which]


def _block_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Hash of the words of each block, the same wherever it lies.  hashes: of words."""
    power, back = powers(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes) * power[: len(hashes)], dtype=U64)])
    return mix((total[starts + lengths + window - 1] - total[starts]) * back[starts] + lengths.astype(U64))


def _given(column: pa.Array, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a column lists for the texts of a chunk, and the place of the text of each."""
    lists = column.slice(chunk.first, len(chunk.bounds) - 1)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return lists.flatten().to_numpy().view(U64), np.repeat(np.arange(len(counts)), counts)


def _within(values: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Numbers that tell apart equal values of different texts, and other values of one text."""
    return values ^ mix(texts.astype(U64) + U64(1))


def _sequences(rows: DataFrame) -> DataFrame:
    """doc_id, n_words and fingerprint of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), PLAIN_WORDS, CHUNK):
                n = len(chunk.bounds) - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, n), pa.array(np.diff(chunk.bounds), pa.int64()), pa.array(_fingerprints(chunk), pa.int64())], names=["doc_id", "n_words", "mark"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, mark bigint")


def _anchor_lists(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, fingerprint and distinct anchors of each text that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), PLAIN_WORDS, CHUNK):
                blocks = _Blocks(chunk, window)
                blocks.only(np.lexsort((blocks.anchors, blocks.texts)))
                blocks.only(np.concatenate([np.ones(1, bool), (blocks.anchors[1:] != blocks.anchors[:-1]) | (blocks.texts[1:] != blocks.texts[:-1])])[: len(blocks.starts)])
                some, counts = np.unique(blocks.texts, return_counts=True)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = batch.column("doc_id").take(pa.array(some + chunk.first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(_fingerprints(chunk)[some], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(blocks.anchors)))], names=["doc_id", "mark", "anchors"])

    return rows.mapInArrow(run, "doc_id bigint, mark bigint, anchors array<bigint>")


def _shared_blocks(rows: DataFrame, window: int, with_words: bool) -> DataFrame:
    """doc_id, anchor and hash of each block with a shared anchor, and its words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), PLAIN_WORDS, CHUNK):
                blocks = _Blocks(chunk, window)
                blocks.only(np.isin(_within(blocks.anchors, blocks.texts), _within(*_given(batch.column("anchors"), chunk))))
                hashes = _block_hashes(chunk.hashes, blocks.starts, blocks.lengths, window)
                ids = batch.column("doc_id").take(pa.array(blocks.texts + chunk.first))
                columns = [ids, pa.array(signed(blocks.anchors)), pa.array(signed(hashes))]
                if with_words:
                    columns.append(_packed(chunk.hashes, blocks.starts, blocks.lengths + window - 1))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "anchor", "block", "words"][: len(columns)])

    return rows.mapInArrow(run, "doc_id bigint, anchor bigint, block bigint" + ", words binary" * with_words)


def _matched(blocks: DataFrame, window: int) -> DataFrame:
    """block and, for each of its windows, the smallest doc_id of a block with the same anchor that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes, int]]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "words", "low")), strict=True)

        names, lows = [], []
        for _, group in itertools.groupby(rows(), key=lambda r: r[0]):
            shard = [(block, words, low) for _, block, words, low in group]
            if len(shard) == 1:  # one passage: all its windows have its label
                found = [[shard[0][2]] * (len(shard[0][1]) // BYTES - window + 1)]
            else:
                automaton = SuffixAutomaton()
                shard = [(block, _unpacked(words).tolist(), low) for block, words, low in shard]
                for _, words, low in shard:
                    automaton.add(words, low)
                automaton.finish()
                found = [automaton.lows(words, window) for _, words, _ in shard]
            names += [block for block, _, _ in shard]
            lows += found
            if len(names) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lows, pa.list_(pa.int64()))], names=["block", "lows"])
                names, lows = [], []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lows, pa.list_(pa.int64()))], names=["block", "lows"])

    return blocks.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "block bigint, lows array<bigint>")


def _by_window(blocks: DataFrame, window: int) -> DataFrame:
    """As _matched, for anchors with more blocks than a shard holds: windows meet under a hash of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at, hashes, lows = [], [], [], []
            for block, words, low in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "low")), strict=True):
                own = _unpacked(words)
                n = len(own) - window + 1
                names += [block] * n
                at += range(n)
                lows += [low] * n
                hashes.append(_block_hashes(own, np.arange(n), np.ones(n, np.int64), window))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at, pa.int32()), pa.array(signed(np.concatenate(hashes)) if hashes else [], pa.int64()), pa.array(lows, pa.int64())], names=["block", "at", "window", "low"])

    windows = blocks.mapInArrow(run, "block bigint, at int, window bigint, low bigint")
    least = windows.groupBy("window").agg(F.min("low").alias("low"))
    return windows.select("block", "at", "window").join(least, "window").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "low"))).alias("x")).select("block", F.col("x.low").alias("lows"))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_words, n_removed and kept_text of each row of docs.

    A window is that many consecutive words of one text, words being runs without ASCII white space.  A
    word goes if a window over it also starts in a row with a smaller doc_id; kept_text has the
    other words, joined by one space.  Windows are judged on the input.

    A null, empty or short text has no window and keeps its words; kept_text of a null is empty.  A row
    without a doc_id keeps all its words and takes none from others.  Rows that share a doc_id
    don't take words from each other.  Only doc_id and text are used.
    """
    bare = docs.select("doc_id", "text")
    sequences = saved(_sequences(bare).where("doc_id is not null"), "sequences")
    first = sequences.where(F.col("n_words") >= window).groupBy("mark", "n_words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = saved(sequences.join(first, ["mark", "n_words"]).where("doc_id != low").select("doc_id", "mark").distinct(), "copies")
    named = bare.where("doc_id is not null")

    lists = _anchor_lists(named, window).join(F.broadcast(copies) if small_enough(copies, 64) else copies, ["doc_id", "mark"], "left_anti")
    spread = lists.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    marked = saved(spread.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "marked")
    candidates = named.join(marked, "doc_id")

    distinct = saved(_shared_blocks(candidates, window, True).groupBy("anchor", "block", "words").agg(F.min("doc_id").alias("low")), "blocks")
    hot = saved(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("anchor"), "hot")
    if hot.isEmpty():
        matched = _matched(distinct, window)
    else:
        matched = _matched(distinct.join(hot, "anchor", "left_anti"), window).unionByName(_by_window(distinct.join(hot, "anchor"), window))
    occurrences = _shared_blocks(candidates, window, False).select("doc_id", "block").distinct()
    taken = F.aggregate(F.transform("lows", lambda low, i: F.when(low < F.col("doc_id"), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x + y)
    flags = occurrences.join(matched, "block").select("doc_id", "block", taken.alias("bits")).where("bits != 0")
    gone = copies.select("doc_id", "mark", F.lit(None).cast("struct<block:bigint,bits:bigint>").alias("flag")).unionByName(flags.select("doc_id", F.lit(None).cast("bigint").alias("mark"), F.struct("block", "bits").alias("flag")))
    gone = saved(gone.groupBy("doc_id").agg(F.collect_set("mark").alias("copies"), F.collect_list("flag").alias("flags")), "gone")
    judged = bare.join(gone, "doc_id", "left").select("doc_id", "text", "copies", F.col("flags.block").alias("blocks"), F.col("flags.bits").alias("bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), PLAIN_WORDS, CHUNK):
                counts = np.diff(chunk.bounds)
                change = np.zeros(len(chunk.hashes) + 1, np.int64)
                known, where = _given(batch.column("blocks"), chunk)
                if len(known):
                    blocks, known = _Blocks(chunk, window), _within(known, where)
                    order = np.argsort(known)
                    known, bits = known[order], _given(batch.column("bits"), chunk)[0][order]
                    own = _within(_block_hashes(chunk.hashes, blocks.starts, blocks.lengths, window), blocks.texts)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    found = known[at] == own
                    bits, starts, lengths = bits[at[found]], blocks.starts[found], blocks.lengths[found]
                    nth = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    first = (np.repeat(starts, lengths) + nth)[(np.repeat(bits, lengths) >> nth.astype(U64)) & U64(1) == 1]
                    change[first] += 1  # a window is in one block
                    change[first + window] -= 1
                marks, where = _given(batch.column("copies"), chunk)
                where = np.unique(where[(marks == _fingerprints(chunk).view(U64)[where]) & (counts[where] >= window)])
                np.add.at(change, chunk.bounds[where], 1)
                np.add.at(change, chunk.bounds[where + 1], -1)
                gone = np.cumsum(change[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])[chunk.bounds]
                part = [batch.column(c).slice(chunk.first, len(counts)) for c in ("doc_id", "text")]
                yield pa.RecordBatch.from_arrays([*part, pa.array(counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), chunk.joined(~gone)], names=["doc_id", "text", "n_words", "n_removed", "kept_text"])

    return judged.mapInArrow(run, "doc_id bigint, text string, n_words bigint, n_removed bigint, kept_text string")


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs."""
    return repeated_spans(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
