"""Mixing sources to target weights by entropy balancing.

Rates r of documents minimise their token-weighted relative entropy to given prior rates, under
one constraint per source: its documents' sizes times rates sum to its target.  The solution tilts
priors exponentially, r = min(most, prior * exp(lambda of the source)); lambda solves the convex
dual, here by Newton steps whose sums are distributed.  Rates are then rounded into copies.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievenet.llm.tables import saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
MOST = 2  # copies of a document at most, and tokens of a source as a multiple of its own
UNIT = 1 << 24  # rates are summed in whole units of 1 / UNIT, so that sums don't depend on their order


def numbered(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A small stored table with a running number from 0 in this order: ranges are numbered apart and offset."""
    parts = saved(frame.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}  # one row per range
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(before)]
        before += sizes[part]
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    offset = F.create_map(*offsets)[F.col("__part")] if offsets else F.lit(0)
    return parts.withColumn("n", (own + offset).cast("long")).drop("__part")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = MOST) -> DataFrame:
    """source, source_size, target: weights repeat over the sources in code point order, null last.

    The targets share `share` times all sizes by weight; none is over `most` times its source's size, and
    what that cuts off is shared out again.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "sources")
    ranked = saved(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("double")), "weights")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, None
    while level != before:  # grows with each source that reaches its limit, so it ends
        over = F.col("weight") * level > most * F.col("source_size")
        full, free = ranked.agg(F.sum(F.when(over, most * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        level, before = (total - float(full or 0)) / free if free else level, level
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double")).alias("target"))


def tilts(sizes: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """source, tilt: Newton's solution of the dual for stored goals (source, target) over sizes (source, size, prior).

    Sizes are summed by source and prior first.  The dual is convex, so its derivative increases in each
    tilt; steps that leave the bracket found so far, or start where all rates are at their limit, go to its
    middle instead.  It ends when every source is within a billionth of its target.
    """
    sums = saved(sizes.groupBy("source", "prior").agg(F.sum("size").alias("tokens")).where("tokens > 0 and prior > 0"), "sums")
    state = saved(goals.select("source", "target", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")), "tilts")
    while True:
        tilted = F.col("prior") * F.exp("tilt")
        made = sums.join(state, sums.source.eqNullSafe(state.source)).select(state.source, "target", "tilt", "low", "high", F.when(tilted >= most, F.lit(0.0)).otherwise(tilted * F.col("tokens")).alias("slope"), (F.least(tilted, F.lit(float(most))) * F.col("tokens")).alias("tokens"))
        moved = made.groupBy("source", "target", "tilt", "low", "high").agg(F.sum("slope").alias("slope"), F.sum("tokens").alias("tokens"))
        short = F.col("target") - F.col("tokens")
        far = (F.abs(short) > 1e-9 * F.col("target")) & (F.col("target") > 0) & ((F.col("slope") > 0) | (short < 0))
        low, high = F.when(short > 0, F.col("tilt")).otherwise(F.col("low")), F.when(short < 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + F.when(F.col("slope") > 0, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), short / F.col("slope")))).otherwise(-1.0)
        step = F.when((newton <= low) | (newton >= high), F.coalesce((low + high) / 2, newton)).otherwise(newton)
        state = saved(moved.select("source", "target", F.when(far, step).otherwise(F.col("tilt")).alias("tilt"), low.alias("low"), high.alias("high"), far.alias("far")), "tilts")
        if state.where("far").isEmpty():
            return state.select("source", "tilt", (F.col("target") <= 0).alias("none"))


def _rounded(rates: DataFrame) -> DataFrame:
    """rates (source, size, rate, ...) with copies and at, a number of the row.

    In each source rates are summed from the longest document on and a copy is due whenever the sum passes
    a half: the tokens taken differ from those due by half the longest document at most.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.xxhash64("doc_id"), F.col("doc_id"), F.col("mark")]
    units = F.round(F.col("rate") * UNIT).cast("long")
    parts = saved(rates.withColumn("units", units).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "rates")
    window = Window.partitionBy("part", "source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("part", "source").agg(F.sum("units").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(F.col("part").alias("p"), F.col("source").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    summed = parts.withColumn("upto", F.sum("units").over(window)).withColumn("row", F.row_number().over(Window.partitionBy("part", "source").orderBy(*order[1:])))
    summed = summed.join(before, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("upto") + F.col("before") + UNIT // 2)
    copies = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("units")) / UNIT)
    return saved(summed.withColumn("copies", copies.cast("long")).withColumn("at", F.struct("part", "source", "row")).drop("p", "s", "before", "upto", "row"), "rounded")


def _corrected(rounded: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """copies after a few documents per source changed by one copy, to meet the target to within small documents.

    The candidates are the longest of each size class, direction and hash slot: a bounded number per source.
    """
    taken = rounded.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    miss = goals.join(taken, goals.source.eqNullSafe(taken.source)).select(goals.source.alias("s"), (F.col("target") - F.col("taken")).alias("miss"))
    up = (F.col("miss") > 0) & (F.col("copies") < most)
    down = (F.col("miss") < 0) & (F.col("copies") > 0)
    fit = rounded.join(miss, rounded.source.eqNullSafe(miss.s)).where((up | down) & (F.col("size") > 0) & (F.col("size") <= F.abs("miss")))
    slots = fit.groupBy("source", "miss", F.floor(F.log2("size")).alias("class"), F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("slot")).agg(F.max(F.struct("size", "doc_id", "mark", "at")).alias("best"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id"], ascending=False, kind="stable")
        miss, sign, chosen = abs(rows["miss"].iloc[0]), 1 if rows["miss"].iloc[0] > 0 else -1, []
        for part, row, size in zip(rows["part"], rows["row"], rows["size"], strict=True):
            if size <= miss:
                miss -= size
                chosen.append((part, row))
        return pd.DataFrame([(rows["source"].iloc[0], p, r, sign) for p, r in chosen], columns=["source", "part", "row", "change"])

    picked = slots.select("source", "miss", "best.size", "best.doc_id", "best.at.part", "best.at.row")
    changes = saved(picked.groupBy("source").applyInPandas(choose, "source string, part int, row int, change int"), "changes")
    changes = changes.select(F.struct("part", "source", "row").alias("at"), "change")
    same = lambda a, b: (a.at.part == b.at.part) & (a.at.row == b.at.row) & a.at.source.eqNullSafe(b.at.source)
    return rounded.join(changes, same(rounded, changes), "left").select(*[rounded[c] for c in rounded.columns if c not in ("copies", "at")], (rounded.copies + F.coalesce("change", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, goals: Callable[[DataFrame], DataFrame] = targets, prior: str | None = None, most: int = MOST) -> DataFrame:
    """doc_id, mark, source, size, source_size, target, rate, copies and taken of each row of docs.

    size counts the words of text (null: 0).  goals maps (source, source_size) to those with a target.
    prior names a column of prior rates; without one all are 1.  taken is copies times size; copies are
    0 to most, and copies of empty documents follow their rate too.  Null is a source of its own.  mark is a
    hash of the text.  An empty table gives an empty result.
    """
    own = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = saved(docs.select(F.col("doc_id"), F.xxhash64("text").alias("mark"), F.col("source"), own.alias("size"), (F.col(prior).cast("double") if prior else F.lit(1.0)).alias("prior")), "sizes")
    aims = saved(goals(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "goals")
    found = saved(tilts(sizes, aims, most), "tilt").withColumnRenamed("source", "s")
    tilted = sizes.join(found, sizes.source.eqNullSafe(F.col("s")), "left")
    rate = F.when(F.coalesce("none", F.lit(False)), 0.0).otherwise(F.least(F.lit(float(most)), F.coalesce("prior", F.lit(0.0)) * F.exp(F.coalesce("tilt", F.lit(0.0)))))
    rounded = _rounded(tilted.select("doc_id", "mark", "source", "size", rate.alias("rate")))
    final = _corrected(rounded, aims, most)
    aims = aims.withColumnRenamed("source", "s")
    joined = final.join(aims, final.source.eqNullSafe(F.col("s")))
    return joined.select("doc_id", "mark", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of docs, and source, rate and copies."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """docs, each row as often as it has copies, and copy, from 1, in place of a column of that name.

    Rows that agree in doc_id, source and text count as one, repeated.
    """
    key = ["doc_id", "mark", "source"]
    copies = saved(mix(docs).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")), "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("mark"), "source")
    if not copies.where("rows > 1").isEmpty():
        rows = rows.dropDuplicates(key)
    met = copies.source.eqNullSafe(rows.source) & (copies.mark == rows.mark) & copies.doc_id.eqNullSafe(rows.doc_id)
    out = rows.join(copies.where("copies > 0"), met).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "copy"], "copy")
