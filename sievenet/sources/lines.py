"""Text files as numbered lines, split across tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievenet.functions.urls import unescape_path


def read_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Columns ``file, chunk, line_no, value``; a CR before the LF is dropped.

    Files are read in splits.  A line's number is its place in its split plus
    the lines of earlier splits, so only one row per split is ever ordered and
    a huge file is never one task's work.
    """
    raw = (
        spark.read.options(lineSep="\n", **options)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("_id"),
            "value",
        )
    )
    splits = raw.groupBy("file", "chunk").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return raw.join(offsets, ["file", "chunk"]).select(
        unescape_path(F.col("file")).alias("file"),
        "chunk",
        (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"),
        F.regexp_replace("value", "\\r\\z", "").alias("value"),
    )
