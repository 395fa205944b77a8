"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (by hash) is cut into fragments.  Sets whose Jaccard
similarity reaches the threshold differ in at most H n-grams, so with more than H
fragments some fragment is equal in both: equal fragments give the candidates.
Candidates that sketches as long as their sets still allow are verified by overlaps counted
per fragment and summed per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievenet.llm.components import components
from sievenet.llm.tables import compact, saved, sized_join
from sievenet.llm.words import FOLDED_WORDS, U64, Chunk, chunks, grams, mix, signed

RATIO = 1.5  # sizes of a class lie within this factor
SKETCH = 8  # 64-bit words of a set's parity sketch
SPARE = 1.1  # fragments for each that may differ; some are empty
DENSE = 64  # comparisons per posting up to which all pairs that are apart are tested
FEW = 1 << 24  # comparisons that take less time than another round; they are made at once if few enough pairs come of them
OVERLAP_CUT = 1024  # n-grams of a set in one vertical partition, about


def _sets(chunk: Chunk, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's index and its sorted distinct n-gram hashes; a shorter text is one n-gram."""
    hashes = chunk.grams(words)
    for i, a, b in chunk.texts():
        if b - a >= words:
            yield i, np.unique(hashes[a : b - words + 1])
        else:
            yield i, grams(chunk.hashes[a:b], b - a)[:1] if b > a else np.zeros(0, U64)


def _parities(own: np.ndarray, level: int = 0) -> np.ndarray:
    """For each of SKETCH * 64 slots, or 2 ** level times as many, whether an odd number of n-grams falls in it.

    Two sketches of a level differ in no more bits than their sets in n-grams.
    """
    slots = SKETCH * 64 << level
    odd = np.bincount((own & U64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Signatures:
    """Fragment signatures of a set of n-gram hashes for a threshold."""

    def __init__(self, numerator: int, denominator: int):
        t = Fraction(numerator, denominator)
        self.t = t
        self.share = (1 - t) / (1 + t)  # differing n-grams, of both sizes together
        tops = [1]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, int(tops[-1] * RATIO)))
        self.tops = np.array(tops)  # class k: sizes over tops[k - 1], up to tops[k]

    def classes(self, size: int) -> range:
        """Size classes of the largest set that a set of this size can link with, from its own on."""
        first = int(np.searchsorted(self.tops, size))
        return range(first, int(np.searchsorted(self.tops, math.floor(size / self.t))) + 1)

    def of(self, ordered: np.ndarray) -> np.ndarray:
        size, out = len(ordered), []
        if not size:
            return np.zeros(0, U64)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(ordered), dtype=U64)])
        for k in self.classes(size):
            differ = math.floor(2 * int(self.tops[k]) * self.share)
            if not differ:
                continue  # only equal sets link, and those are one class already
            n = math.ceil((differ + 1) * SPARE) + 1
            cuts = np.searchsorted(ordered, (np.arange(1, n, dtype=U64) * U64((1 << 64) // n)))
            cuts = np.concatenate([[0], cuts, [size]])
            some = cuts[1:] > cuts[:-1]
            # the most that this set and any partner of the class can differ in; an equal fragment is empty in both or in neither
            own = math.floor((size + min(int(self.tops[k]), math.floor(size / self.t))) * self.share)
            if n - np.count_nonzero(~some) <= own:
                some[:] = True  # so many empty fragments that those may be the only equal ones
            at = np.flatnonzero(some)
            value = total[cuts[at + 1]] - total[cuts[at]]
            out.append(mix(value ^ mix((at.astype(U64) << U64(20)) + U64(k + 1))))
        return np.concatenate(out) if out else np.zeros(0, U64)


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and two fingerprints of the set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), FOLDED_WORDS):
                sizes, one, two = [], [], []
                for _, own in _sets(chunk, words):
                    sizes.append(len(own))
                    one.append(int(signed(np.sum(mix(own), dtype=U64).reshape(1))[0]))
                    two.append(int(signed(np.sum(mix(own ^ U64(0x5851F42D4C957F2D)), dtype=U64).reshape(1))[0]))
                ids = batch.column("doc_id").slice(chunk.first, len(sizes))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["doc_id", "n_shingles", "f1", "f2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint")


def _signatures(docs: DataFrame, words: int, signatures: Signatures) -> DataFrame:
    """doc_id and signatures of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), FOLDED_WORDS):
                every = [signed(signatures.of(own)) for _, own in _sets(chunk, words)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(every)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(chunk.first, len(every)), lists], names=["doc_id", "signatures"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, signatures array<bigint>")


def _sketches(docs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """doc_id, size and parity sketch of each row's set, and longer sketches of sets that may meet in a pair of a higher level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), FOLDED_WORDS):
                sets = [own for _, own in _sets(chunk, words)]
                longer = [[(level, _parities(x, level)) for level in _levels(len(x), t, SKETCH * 64) if level] for x in sets]
                kind = pa.list_(pa.struct([("level", pa.int32()), ("bits", pa.list_(pa.int64()))]))
                columns = [batch.column("doc_id").slice(chunk.first, len(sets)), pa.array([len(x) for x in sets], pa.int64()), pa.array([_parities(x) for x in sets], pa.list_(pa.int64())), pa.array(longer, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sketch", "longer"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, sketch array<bigint>, longer array<struct<level: int, bits: array<bigint>>>")


def _levels(size: int, t: Fraction, cut: int) -> range:
    """How often cut is doubled to pass a set of this size, and the largest set it can link with."""
    level = lambda n: max(0, (n // cut).bit_length())
    return range(level(size), level(math.floor(size / t)) + 1)


def _level(cut: int) -> Column:
    """The level of a pair: that of its larger set, which is among the levels of both."""
    return F.length(F.regexp_replace(F.bin(F.floor(F.greatest("sa", "sb") / cut)), "^0$", ""))


def _parts(docs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """Vertical partitions of each row's set: doc_id, level, part and the n-grams of that part, 2 ** level parts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for chunk in chunks(batch.column("text"), FOLDED_WORDS):
                rows = []
                for i, own in _sets(chunk, words):
                    for level in _levels(len(own), t, OVERLAP_CUT):
                        edges = np.arange(1, 1 << level, dtype=U64) << U64(64 - level) if level else np.zeros(0, U64)
                        for part, grams_of_part in enumerate(np.split(signed(own), np.searchsorted(own, edges))):
                            rows.append((names[i], level, part, grams_of_part))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "level", "part", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, level int, part bigint, grams array<bigint>")


def _plausible(pairs: DataFrame, known: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b, sa, sb) whose sets may link by sketches longer than the larger set.

    A short sketch can't tell large sets apart, and their n-grams are what verifying moves.
    """
    level = _level(SKETCH * 64)
    longer = known.select("doc_id", F.explode("longer").alias("x")).select("doc_id", "x.level", "x.bits")
    one = longer.select(F.col("doc_id").alias("a"), "level", F.col("bits").alias("of_a"))
    two = longer.select(F.col("doc_id").alias("b"), "level", F.col("bits").alias("of_b"))
    each = F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(each, F.lit(0), lambda total, x: total + x)
    met = pairs.withColumn("level", level).where("level > 0").join(one, ["a", "level"]).join(two, ["b", "level"])
    near = met.where(differ * (t.denominator + t.numerator) <= (F.col("sa") + F.col("sb")) * (t.denominator - t.numerator))
    return pairs.where(level == 0).unionByName(near.select("a", "b", "sa", "sb").distinct())  # once for repeated rows


def _verified(docs: DataFrame, pairs: DataFrame, words: int, t: Fraction) -> DataFrame:
    """The links among the stored pairs (a, b, sa, sb): overlaps counted per part of the order, then summed per pair."""
    pairs = compact(pairs, 32)
    used = saved(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "paired")
    parts = saved(_parts(sized_join(docs.select("doc_id", "text"), used, "doc_id", "left_semi", 32), words, t), "parts")
    one = parts.select(F.col("doc_id").alias("a"), "level", "part", F.col("grams").alias("of_a"))
    two = parts.select(F.col("doc_id").alias("b"), "level", "part", F.col("grams").alias("of_b"))
    counted = pairs.withColumn("level", _level(OVERLAP_CUT)).join(one, ["a", "level"]).join(two, ["b", "level", "part"])
    partial = counted.select("a", "b", "sa", "sb", "part", F.size(F.array_intersect("of_a", "of_b")).alias("n")).groupBy("a", "b", "sa", "sb", "part").agg(F.max("n").alias("n"))  # once for repeated rows
    overlaps = partial.groupBy("a", "b", "sa", "sb").agg(F.sum("n").alias("both"))
    return overlaps.where(t.denominator * F.col("both") >= t.numerator * (F.col("sa") + F.col("sb") - F.col("both"))).select("a", "b")


def _may_link(t: Fraction) -> F.Column:
    """For rows (n, sketch, m, sketch_m): whether sizes allow a link, and the bits in which the sketches differ."""
    differ = sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("sketch_m", F.lit(i)))) for i in range(SKETCH)), F.lit(0))
    sizes = F.least("n", "m") * t.denominator >= F.greatest("n", "m") * t.numerator
    return sizes & (differ * (t.denominator + t.numerator) <= (F.col("n") + F.col("m")) * (t.denominator - t.numerator))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b, with sizes) of candidate rows (doc_id, n, other, m)."""
    first = F.col("doc_id") < F.col("other")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return rows.select(pick("doc_id", "other").alias("a"), pick("other", "doc_id").alias("b"), pick("n", "m").alias("sa"), pick("m", "n").alias("sb")).distinct()


def jaccard_components(docs: DataFrame, words: int = 3, numerator: int = 90, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    Two rows link when denominator * intersection >= numerator * union of their sets of
    words-grams; component_id is the smallest doc_id that links reach.  Equal sets form one class
    with one representative, so copies make no pairs.  Representatives meet in fragments that are
    equal in both; in rounds each is compared with one member that shares a fragment, chosen anew each time,
    until what is still apart can be compared pair by pair, so no link between different sets is lost
    unless its ends are joined already.  Sketches reject most pairs that can't link before they
    become rows, and longer ones most of those of large sets before their n-grams are moved.

    A null, empty or wordless text has no n-gram and links with nothing.  Rows without a doc_id get
    a null component.  A doc_id names one text; rows that repeat both give a row each.  Only doc_id and
    text are used.
    """
    signatures = Signatures(numerator, denominator)
    t = signatures.t
    rows = saved(_summaries(docs, words), "sets")
    key = ["f1", "f2", "n_shingles"]
    classes = saved(rows.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    copies = saved(rows.join(classes.where("copies > 1"), key).where("doc_id != rep").select("doc_id"), "copies")
    texts = docs.where("doc_id is not null")
    only_reps = lambda frame: sized_join(frame, copies, "doc_id", "left_anti", 32)
    spread = only_reps(_signatures(texts, words, signatures)).select("doc_id", F.explode("signatures").alias("s"))
    # most signatures are of one row only: they are shuffled once, and counted where they lie
    postings = saved(spread.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("k > 1").select("s", "doc_id"), "postings")
    paired = saved(postings.select("doc_id").distinct(), "paired")
    known = saved(sized_join(_sketches(texts, words, t), paired, "doc_id", "left_semi", 32), "known")

    tried: DataFrame | None = None
    links: DataFrame | None = None
    joined = None  # (doc_id, component)
    turn, gained = 0, False
    while True:
        now = postings if joined is None else sized_join(postings, joined, "doc_id", "left", 32)
        now = now.select("s", "doc_id", F.col("doc_id").alias("c") if joined is None else F.coalesce("component", "doc_id").alias("c"))
        per = now.groupBy("s", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        apart = saved(per.where("k * k > kk"), "apart")
        left, members = apart.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2), F.sum("k")).first()
        if not left:
            break
        now = sized_join(sized_join(now, apart.select("s"), "s", "inner", 32), known.select("doc_id", "n", "sketch"), "doc_id", "inner", 256)
        other = lambda frame: frame.select("s", F.col("doc_id").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("sketch_m"), F.col("c").alias("d"))  # noqa: E731, B023
        every = now.join(other(now), "s").where((F.col("doc_id") < F.col("other")) & (F.col("c") != F.col("d")) & _may_link(t))
        last = turn > 0 and (left <= DENSE * members or not gained or left <= FEW and every.count() <= members)
        if last:
            candidates = every
        else:
            rank = F.lit(0).cast("long") if not turn else F.xxhash64("doc_id", "s", F.lit(turn))
            hubs = now.groupBy("s").agg(F.min(F.struct(rank.alias("rank"), "doc_id", "n", "sketch", "c")).alias("hub")).select("s", "hub.*")
            met = now.join(other(hubs), "s").where((F.col("c") != F.col("d")) & _may_link(t))
            # one comparison a round joins a set to its group; the last round makes good what that leaves apart
            one = F.min(F.struct((F.col("other") if not turn else F.xxhash64("other", F.lit(turn))).alias("rank"), F.col("other").alias("other"), F.col("m").alias("m"))).alias("one")
            candidates = met.groupBy("doc_id", "n").agg(one).select("doc_id", "n", "one.other", "one.m")
        pairs = _pairs(candidates.select("doc_id", "n", "other", "m"))
        pairs = saved(pairs if tried is None else sized_join(pairs, tried.select("a", "b"), ["a", "b"], "left_anti", 32), "pairs")
        found = saved(_verified(texts, saved(_plausible(pairs, known, t), "plausible"), words, t), "links")
        gained = not found.isEmpty()
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if gained:
            joined = components(compact(links, 16))
            joined = saved(joined.withColumnRenamed("node", "doc_id"), "joined")
        turn += 1
        if last:
            break
    reps = classes.select(*key, "rep")
    if joined is not None:
        reps = reps.join(joined, F.col("rep") == F.col("doc_id"), "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    else:
        reps = reps.select(*key, F.col("rep").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", *key).join(reps, key, "left").select("doc_id", "n_shingles", own.alias("component_id"))


def one_per_group(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its group; rows without a doc_id stay.  Columns stay."""
    gone = jaccard_components(docs, words, numerator, denominator).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
