"""Benchmark decontamination: a broadcast set of test n-grams, scanned over every training text."""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievenet.llm.tables import BROADCAST_BYTES, parts_for, saved
from sievenet.llm.words import grams

WINDOW = 13
BLOCK_BYTES = 16 << 20  # benchmark text held by a task at once; its arrays take about five times that
SPOTS = 1 << 16  # places of a text that are verified at once

# Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8."""
    return [] if text is None else text.translate(_FOLD).split()


class TestGrams:
    """The windows of some benchmark items, as arrays: hashes in order, and the item and first word of each.

    Item words are numbers in one array, against which hits are verified.  A window takes 16 bytes and a word 4,
    besides the distinct words.
    """

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = [None if item is None else str(item) for item, _ in items]
        texts = [np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int32) for _, text in items]
        self.words = np.concatenate([np.zeros(0, np.int32), *texts])
        ends = np.cumsum([0, *map(len, texts)])
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, own in enumerate(texts):
            size = min(window, len(own))
            if size:
                hashes = grams(own.astype(np.uint64), size)[: len(own) - size + 1]
                held.setdefault(size, []).append((hashes, np.full(len(hashes), k, np.int32), np.arange(ends[k], ends[k] + len(hashes), dtype=np.int32)))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in held.items():
            hashes, owner, start = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((start, owner, hashes))
            hashes, owner, start = hashes[order], owner[order], start[order]
            # a window that an item repeats is kept once
            again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) + 1
            again = again[self._equal(start[again], self.words, start[again - 1], size)]
            keep = np.ones(len(hashes), bool)
            keep[again] = False
            self.windows[size] = hashes[keep], owner[keep], start[keep]

    def _equal(self, starts: np.ndarray, other: np.ndarray, spots: np.ndarray, size: int) -> np.ndarray:
        """Whether the windows from starts are, word by word, those of other from spots."""
        same = np.ones(len(starts), bool)
        for k in range(size):
            same &= self.words[starts + k] == other[spots + k]
        return same

    def scan(self, text_words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words of a text lie in an occurrence of a window, and the items whose windows occur."""
        edges = np.zeros(len(text_words) + 1, np.int64)
        items: set[int] = set()
        get = self.number.get
        numbers = np.array([get(w, -1) for w in text_words], np.int64)
        known = np.concatenate([[0], np.cumsum(numbers >= 0)])
        for size, (hashes, owner, start) in self.windows.items():
            if len(numbers) < size:
                continue
            where = np.flatnonzero(known[size:] - known[:-size] == size)  # every word is one of the benchmark's
            if not len(where):
                continue
            found = grams(numbers.astype(np.uint64), size)[where]
            low = np.searchsorted(hashes, found)
            there = hashes[np.minimum(low, len(hashes) - 1)] == found
            where, low = where[there], low[there]
            high = np.searchsorted(hashes, found[there], "right")
            for i in range(0, len(where), SPOTS):
                spots, place, left = where[i : i + SPOTS], low[i : i + SPOTS].copy(), high[i : i + SPOTS]
                while len(spots):  # one window of each spot at a time
                    good = self._equal(start[place], numbers, spots, size)
                    np.add.at(edges, spots[good], 1)
                    np.add.at(edges, spots[good] + size, -1)
                    items.update(np.unique(owner[place[good]]).tolist())
                    more = place + 1 < left
                    spots, place, left = spots[more], place[more] + 1, left[more]
        return np.cumsum(edges)[:-1] > 0, {self.names[k] for k in items if self.names[k] is not None}


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true, in turn."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edges.tolist()


def _blocks(spark: SparkSession, benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's items in blocks of about block_bytes; each block is collected alone."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts_for(total, block_bytes)
    for k in range(n):
        yield [(r.item_id, r.text.encode()) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()]


SPANS = "n_words long, spans array<int>, items array<string>"


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """row (a struct of all columns of docs), n_words, spans and items, in place: one row for each of docs."""
    spark = docs.sparkSession
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))

    def scanned(rows: DataFrame, key: str, block: list[tuple[object, bytes]], hits_only: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(TestGrams(block, window)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(shared.value)
            for batch in batches:
                counts, spans, items, kept = [], [], [], []
                for k, text in enumerate(batch.column("text").cast(pa.binary())):
                    own = words(text.as_py())
                    hit, found = index.scan(own)
                    if not hits_only or hit.any():
                        kept.append(k)
                        counts.append(len(own))
                        spans.append(_runs(hit))
                        items.append(sorted(found))
                held = batch.column(key) if len(kept) == batch.num_rows else batch.column(key).take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([held, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=[key, "n_words", "spans", "items"])

        schema = StructType([rows.schema[key], *StructType.fromDDL(SPANS).fields])
        return rows.mapInArrow(scan, schema)

    blocks = _blocks(spark, benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return scanned(given, "row", first, False)
    # rows get a number and are stored, and each pass over them leaves those with hits, without text
    stored = saved(given.withColumn("at", F.monotonically_increasing_id()), "numbered")
    numbered = stored.select("at", "text")
    hits = None
    for block in itertools.chain([first, second], blocks):
        more = scanned(numbered, "at", block, True)
        hits = more if hits is None else hits.unionByName(more)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for n, own in zip(batch.column("n").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                hit = np.zeros(n, bool)
                for one in own:
                    for a, b in zip(one[::2], one[1::2], strict=True):
                        hit[a:b] = True
                spans.append(_runs(hit))
            yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("n"), pa.array(spans, pa.list_(pa.int32())), batch.column("items")], names=["at", "n", "spans", "items"])

    # a group has at most as many rows as there are blocks
    found = hits.groupBy("at").agg(F.first("n_words").alias("n"), F.collect_set("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    found = saved(found.mapInArrow(united, "at long, n long, spans array<int>, items array<string>"), "hits")
    size = found.agg(F.sum(32 + 4 * F.size("spans") + 24 * F.size("items"))).first()[0] or 0
    n_words = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))))
    out = stored.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "at", "left")
    return out.select("row", F.coalesce("n", n_words.cast("long")).alias("n_words"), F.coalesce("spans", F.array().cast("array<int>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (start and end word of each maximal run of hit words, in turn) and items.

    Only doc_id and text of docs are kept; there is one row for each of theirs, repeated ids and rows and null ids
    included.  A text that is null or has no word has no hit; long texts are scanned whole.
    The benchmark is held in blocks of block_bytes of text: one pass over docs for each, whose runs are united per row.
    An empty benchmark hits nothing.
    """
    return _marked(docs.select("doc_id", "text"), benchmark, window, block_bytes).select("row.*", "n_words", "spans", "items")


def n_hit() -> F.Column:
    """Hit words, from spans."""
    return F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s.sum + s.sign * x).alias("sum"), (-s.sign).alias("sign")), lambda s: s.sum)


def _contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    found = find_contamination(docs, benchmark).withColumn("n_hit", n_hit())
    ids = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without contaminated rows (remove="documents"), or without the words in hit spans (remove="spans").

    Each row is judged by its own text, whatever its doc_id: null and repeated ids need no care.  Columns and rows
    beyond that stay as they are; rows with null text stay.  For "spans", text is replaced by its unhit parts,
    cut at word bounds.
    """
    found = _marked(docs, benchmark, WINDOW, BLOCK_BYTES)
    if remove == "documents":
        return found.withColumn("n_hit", n_hit()).where(~_contaminated()).select("row.*")
    cut = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.udf(_without, "string")("row.text", "spans"))
    return found.select(*[cut.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def _without(text: str | None, spans: list[int]) -> str | None:
    if text is None or spans is None:
        return text
    raw = text.encode()
    marks = raw.translate(_FOLD)
    at, where = [], 0
    for word in words(raw):
        where = marks.index(word, where)
        at.append((where, where + len(word)))
        where += len(word)
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def digest(values: list[str]) -> str:
    """The items_sha256 of a list of item ids."""
    return hashlib.sha256(",".join(sorted(values)).encode()).hexdigest()
