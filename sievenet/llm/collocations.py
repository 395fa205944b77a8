"""Phrase collocation mining by sorted relations, one phrase length after another.

The occurrences of all frequent phrases of a length are a stored relation, sorted by piece and position.
Joined with itself at the next position it gives the occurrences of longer phrases; those are
counted by group, and only occurrences of frequent groups go into the next relation.

A relation is stored in blocks: the sorted occurrences of up to BLOCK words of one text.  A spot numbers the words of
a block and skips one number between pieces, so "same piece, next position" is "spot + 1".  A
block also holds the words that phrases begun in it may need from the next block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievenet.llm.tables import BROADCAST_BYTES, saved

LONGEST = 5
SUPPORT = 100
BLOCK = 1 << 14  # words of a block
KEPT = 1 << 20  # distinct groups a task counts before it passes them on

# What parts pieces, what parts words, and the letters that are lowered.
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(_PIECE_ENDS + b"\t" + bytes(range(65, 91)), b"\n" * len(_PIECE_ENDS) + b" " + bytes(range(97, 123)))


def _pieces(text: bytes | None) -> list[list[bytes]]:
    """The words of each piece of a text."""
    # only line feeds and blanks are left of what bytes.split() takes for white space
    return [words for piece in (text or b"").translate(_FOLD).split(b"\n") if (words := piece.split())]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[list[bytes]]]]:
    for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.large_binary()), strict=True):
        yield lang.as_py(), _pieces(text.as_py())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n: how often each word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
            flat = [(lang, word, n) for lang, own in counts.items() for word, n in own.items()]
            lang, word, n = zip(*flat, strict=True) if flat else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, pieces in _texts(batch):
                counts.setdefault(lang, Counter()).update(chain.from_iterable(pieces))
                if sum(map(len, counts.values())) > KEPT:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    return docs.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


_RELATION = "block bigint, own int, gaps array<int>, ids array<bigint>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def _gaps(spots: np.ndarray) -> np.ndarray:
    return np.diff(spots, prepend=0)


def _relation(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Blocks (block, own, spots, ids) as rows; spots are stored as distances."""
    blocks, own, spots, ids = zip(*rows, strict=True) if rows else ((), (), (), ())
    columns = [pa.array(blocks, pa.int64()), pa.array(own, pa.int32()), _lists([_gaps(s) for s in spots], pa.int32()), _lists(list(ids), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "own", "gaps", "ids"])


def _blocks(pieces: list[list[bytes]], longest: int) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """own, spots and words of each block of a text: phrases that begin under own are counted in it."""
    words = list(chain.from_iterable(pieces))
    spots = np.arange(len(words)) + np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    for at in range(0, len(words), BLOCK):
        end = min(at + BLOCK, len(words))
        upto = min(end + longest - 1, len(words))
        yield int(spots[end - 1] + 1 - spots[at]), spots[at:upto] - spots[at], words[at:upto]


def _first_relation(docs: DataFrame, frequent: DataFrame, longest: int, small: bool) -> DataFrame:
    """The occurrences of frequent words.  frequent: (id, lang, word)."""
    if small:
        ids = docs.sparkSession.sparkContext.broadcast({(r.lang, bytes(r.word)): r.id for r in frequent.select("id", "lang", "word").collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, dict[bytes, int]] = {}
            for (lang, word), i in ids.value.items():
                known.setdefault(lang, {})[word] = i
            for batch in batches:
                rows = []
                for lang, pieces in _texts(batch):
                    of = known.get(lang, {})
                    for own, spots, words in _blocks(pieces, longest):
                        found = np.array([of.get(w, -1) for w in words], np.int64)
                        if (found >= 0).any():
                            rows.append((0, own, spots[found >= 0], found[found >= 0]))
                yield _relation(rows)

        return docs.mapInArrow(run, _RELATION).withColumn("block", F.monotonically_increasing_id())

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, owns, places, lists = [], [], [], []
            for lang, pieces in _texts(batch):
                for own, spots, words in _blocks(pieces, longest):
                    langs.append(lang)
                    owns.append(own)
                    places.append(spots)
                    lists.append(words)
            columns = [pa.array(langs, pa.string()), pa.array(owns, pa.int32()), _lists(places, pa.int32()), pa.array(lists, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "own", "spots", "words"])

    blocks = saved(docs.mapInArrow(every, "lang string, own int, spots array<int>, words array<binary>").withColumn("block", F.monotonically_increasing_id()), "blocks")
    single = blocks.select("block", "own", "lang", F.explode(F.arrays_zip("spots", "words")).alias("x")).select("block", "own", "lang", F.col("x.spots").alias("spot"), F.col("x.words").alias("word"))
    return _regrouped(single.join(frequent.select("id", "lang", "word"), ["lang", "word"]))


def _regrouped(rows: DataFrame) -> DataFrame:
    """Occurrences (block, own, spot, id) as sorted blocks; a block's are bounded by its words."""
    sorted_rows = rows.groupBy("block", "own").agg(F.array_sort(F.collect_list(F.struct("spot", "id"))).alias("x"))
    before = F.concat(F.array(F.lit(0)), F.slice("x.spot", F.lit(1), F.size("x") - 1))
    return sorted_rows.select("block", "own", F.zip_with("x.spot", before, lambda a, b: (a - b).cast("int")).alias("gaps"), F.col("x.id").alias("ids"))


def _joined(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The relation merged with itself at the next position: block, own, and spot, first and second id of each match."""
    gaps, ids = batch.column("gaps"), batch.column("ids")
    flat_gaps, flat_ids = gaps.values.to_numpy(zero_copy_only=False), ids.values.to_numpy(zero_copy_only=False)
    ends = gaps.offsets.to_numpy()
    for k, (block, own) in enumerate(zip(batch.column("block").to_pylist(), batch.column("own").to_pylist(), strict=True)):
        low, high = ends[k], ends[k + 1]
        spots, own_ids = np.cumsum(flat_gaps[low:high], dtype=np.int64), flat_ids[low:high]
        at = np.flatnonzero(spots[1:] == spots[:-1] + 1)
        yield block, own, spots[at], own_ids[at], own_ids[at + 1]


def _counted(relation: DataFrame) -> DataFrame:
    """a of each pair (head, tail) of neighbours in the relation: phrases one word longer."""

    def groups(heads: list[np.ndarray], tails: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        head, tail, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (heads, tails, n))
        order = np.lexsort((tail, head))
        head, tail, count = head[order], tail[order], count[order]
        new = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])) if len(head) else np.zeros(0, np.int64)
        return head[new], tail[new], np.add.reduceat(count, new) if len(new) else count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        heads, tails, size = [], [], 0

        def merged(last: bool) -> Iterator[pa.RecordBatch]:
            now = [groups(heads, tails, [np.ones(size, np.int64)])] if size else []
            done[:] = [groups(*map(list, zip(*done, *now, strict=True)))] if done or now else []
            if done and (last or len(done[0][0]) > KEPT):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in done[0]], names=["head", "tail", "n"])
                done.clear()

        for batch in batches:
            for _, own, spots, head, tail in _joined(batch):
                mine = spots < own
                heads.append(head[mine])
                tails.append(tail[mine])
                size += int(mine.sum())
                if size > KEPT:
                    yield from merged(False)
                    heads, tails, size = [], [], 0
        yield from merged(True)

    return relation.select("block", "own", "gaps", "ids").mapInArrow(run, "head bigint, tail bigint, n bigint").groupBy("head", "tail").agg(F.sum("n").alias("a"))


class _Lookup:
    """ids of pairs (head, tail), by search in sorted arrays."""

    def __init__(self, ids: np.ndarray, head: np.ndarray, tail: np.ndarray):
        self.heads, h = np.unique(head, return_inverse=True)
        self.tails, t = np.unique(tail, return_inverse=True)
        keys = h * len(self.tails) + t
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    @staticmethod
    def _rank(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return at, known[at] == asked

    def __call__(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The id of each pair, -1 where it isn't known."""
        out = np.full(len(head), -1, np.int64)
        h, in_heads = self._rank(self.heads, head)
        t, in_tails = self._rank(self.tails, tail)
        some = np.flatnonzero(in_heads & in_tails)
        k, known = self._rank(self.keys, h[some] * len(self.tails) + t[some])
        out[some[known]] = self.ids[k[known]]
        return out


def _next_relation(relation: DataFrame, frequent: DataFrame, small: bool) -> DataFrame:
    """The occurrences of frequent longer phrases.  frequent: (id, head, tail)."""
    if small:
        rows = frequent.select("id", "head", "tail").toPandas()
        lookup = relation.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy(np.int64) for c in ("id", "head", "tail")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = _Lookup(*lookup.value)
            for batch in batches:
                out = []
                for block, own, spots, head, tail in _joined(batch):
                    ids = of(head, tail)
                    if (ids >= 0).any():
                        out.append((block, own, spots[ids >= 0], ids[ids >= 0]))
                yield _relation(out)

        return relation.mapInArrow(run, _RELATION)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own, spots, head, tail in _joined(batch):
                n = len(spots)
                columns = [pa.array(np.full(n, block), pa.int64()), pa.array(np.full(n, own), pa.int32()), pa.array(spots, pa.int32()), pa.array(head, pa.int64()), pa.array(tail, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "own", "spot", "head", "tail"])

    single = relation.mapInArrow(every, "block bigint, own int, spot int, head bigint, tail bigint")
    return _regrouped(single.join(frequent.select("id", "head", "tail"), ["head", "tail"]))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for each length from 1, the stored frequent phrases.

    Those are (id, head, tail, lang, words, a, firsts, lasts): head and tail are the ids of the phrase without its
    last and its first word, firsts and lasts the frequencies of its first 1, 2, ... and last 1, 2, ... words.
    Frequent groups are broadcast while they fit broadcast_bytes; larger tables join by shuffle.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = saved(word_counts(rows), "words")
    totals = saved(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    none = F.lit(None).cast("bigint")
    one = words.where(F.col("n") >= support).select(
        F.monotonically_increasing_id().alias("id"), none.alias("head"), none.alias("tail"), "lang", F.array("word").alias("words"), F.col("n").alias("a"), F.array("n").alias("firsts"), F.array("n").alias("lasts")
    )
    found = [saved(one, "phrases")]
    # a word's row in a Python dictionary, with its key
    width = found[0].agg(F.sum(F.octet_length(F.col("words")[0]) + F.octet_length("lang") + 250)).first()[0] or 0
    relation = saved(_first_relation(rows, found[0].withColumn("word", F.col("words")[0]), longest, width <= broadcast_bytes), "occurrences")
    for length in range(2, longest + 1):
        groups = saved(_counted(relation).where(F.col("a") >= support).withColumn("id", F.monotonically_increasing_id()), "groups")
        known = found[-1]
        heads = known.select(F.col("id").alias("head"), "lang", "words", "firsts")
        tails = known.select(F.col("id").alias("tail"), F.element_at("words", -1).alias("word"), "lasts")
        longer = groups.join(heads, "head").join(tails, "tail").select(
            "id", "head", "tail", "lang", F.concat("words", F.array("word")).alias("words"), "a", F.concat("firsts", F.array("a")).alias("firsts"), F.concat("lasts", F.array("a")).alias("lasts")
        )
        found.append(saved(longer, "phrases"))
        if length < longest:
            # three numbers a group, on the driver and in every worker
            relation = saved(_next_relation(relation, groups, groups.count() * 64 <= broadcast_bytes), "occurrences")
    return totals, found


def whole(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)) of whole decimals; the products may pass 64 bits, the score doesn't, as a is at most l and r."""
    over, under = a * n * F.lit(1000), l * r
    # a remainder is exact, so what is left divides evenly
    return ((over - over % under) / under).cast("bigint")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, best: int = 2000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of two words or more of each language.

    Texts are lower-cased (A-Z), parted into pieces at `.,;:!?` and line ends and into words at blanks and tabs;
    phrases lie within a piece.  a is a phrase's frequency, n the number of all words.  Cut after some word, its parts
    have frequencies l and r, and score is floor(1000 * a * n / (l * r)) of the cut that scores lowest, the first
    of equal ones.  Phrases that are rarer than support are no candidates; neither are those that only
    occur inside one longer candidate.  Rows go by score and a, highest first, then by phrase in byte order.

    A null lang is "und"; a null, empty or wordless text adds nothing; repeated rows count each; a text of any
    length is read whole, in blocks.  Only lang and text are used.
    """
    totals, found = frequent_phrases(docs, support, longest, broadcast_bytes)
    kept = None
    for length in range(2, longest + 1):
        phrases = found[length - 1]
        if length < longest:
            above = found[length]
            # a longer phrase is as frequent only if one a word longer is
            inside = above.select(F.explode(F.array("head", "tail")).alias("id"), "a").distinct()
            phrases = phrases.join(inside, ["id", "a"], "left_anti")
        cuts = [F.struct(F.lit(k).alias("k"), F.col("firsts")[k - 1].alias("l"), F.col("lasts")[length - k - 1].alias("r")) for k in range(1, length)]
        rows = phrases.select("lang", F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("phrase"), "a", F.array(*cuts).alias("cuts"))
        kept = rows if kept is None else kept.unionByName(rows)
    scored = kept.join(totals, "lang")
    scored = scored.select("lang", "phrase", "a", "n", F.explode("cuts").alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    scored = scored.withColumn("score", score(whole("a"), whole("n"), whole("l"), whole("r")))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", *(F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")))
