"""Tables that jobs leave in the shared folder, and joins whose broadcast is sized first."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievenet.session import new_dir

BROADCAST_BYTES = 32 << 20
COMPACT_BYTES = 2 << 20  # of rows that one task handles in less time than many tasks take to start


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame's rows, written to the shared folder once and read back: lineage ends here."""
    spark = frame.sparkSession
    path = new_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(frame: DataFrame, row_bytes: int) -> bool:
    """Whether a stored frame's rows, at row_bytes each, may be broadcast."""
    return frame.count() * row_bytes <= BROADCAST_BYTES


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int = 64) -> DataFrame:
    """A join that broadcasts right, a stored table, where its counted rows allow that and shuffles otherwise."""
    return left.join(F.broadcast(right) if small_enough(right, row_bytes) else right, on, how)


def compact(stored: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, in one partition where its counted rows allow that: grouping and joining it shuffles nothing then."""
    return stored.coalesce(1) if stored.count() * row_bytes <= COMPACT_BYTES else stored


def parts_for(total_bytes: float, each: int = 32 << 20) -> int:
    """Partitions of about so many bytes."""
    return max(1, math.ceil(total_bytes / each))


def slices(frame: DataFrame, key: str, row_bytes: int) -> list[Callable[[DataFrame], DataFrame]]:
    """Filters that cut frames by a whole-number key, so that each slice of frame, a stored table, may be broadcast."""
    n = parts_for(frame.count() * row_bytes, BROADCAST_BYTES)
    if n == 1:
        return [lambda rows: rows]
    return [lambda rows, k=k: rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def small_share_join(left: DataFrame, right: DataFrame, on: str, copies: str, share: int = 1000) -> DataFrame:
    """A left join on a key that right, a stored table, holds once, with how many rows of left have it.

    Keys with a thousandth of all rows or more, which are a thousand at most, are broadcast; the others join by
    shuffle, where no key is large.  left should be stored too: it is read twice.
    """
    total = right.agg(F.sum(copies)).first()[0] or 0
    large = F.col(copies) * share >= total
    hot, rest = right.where(large).drop(copies), right.where(~large).drop(copies)
    here = left.join(F.broadcast(hot), on)
    return here.unionByName(left.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on, "left"))
