"""Re-scannable corpora: captures as clustered Parquet with their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievenet.functions.paths import with_relative_path
from sievenet.operators.scope import scope_of, where_in_scope
from sievenet.session import fits_broadcast, new_dir, write_counted

SAVE_MODES = ("scope", "full")


def parse_save_dir(raw: str) -> tuple[str, str]:
    """``[scope:|full:]folder`` as (mode, folder); empty means no saving."""
    raw = raw.strip()
    if not raw:
        return "", ""
    mode, colon, folder = raw.partition(":")
    if colon and mode.strip().lower() in SAVE_MODES:
        mode, folder = mode.strip().lower(), folder.strip()
    else:
        mode, folder = "scope", raw
    if not folder:
        raise ValueError(f"{raw!r} names no folder to save in")
    return mode, folder


def rows_to_save(resources: DataFrame, mode: str = "scope") -> DataFrame:
    """``scope`` keeps rows whose final URL lies in their target, ``full`` all."""
    if mode == "full":
        return resources
    if mode not in ("", "scope"):
        return resources.limit(0)
    columns = resources.columns
    return where_in_scope(resources.withColumn("_scope", scope_of("target_url")), "_scope", "final_url").select(*columns)


def manifest(resources: DataFrame, order: str = "queue_ord") -> DataFrame:
    """Manifest rows; ``ord`` follows ``order`` and may have gaps."""
    return with_relative_path(resources.select(order, "status", "content_type", "final_url")).select(
        F.col(order).cast("bigint").alias("ord"),
        "status",
        "content_type",
        F.col("final_url").alias("url"),
        "relative_path",
    )


def manifest_lines(rows: DataFrame) -> DataFrame:
    """Manifest rows as the tab-separated lines of an ``index.txt``."""
    number = F.when(F.col("ord") < 1_000_000, F.lpad(F.col("ord").cast("string"), 6, "0")).otherwise(F.col("ord").cast("string"))
    line = F.concat_ws("\t", number, F.col("status").cast("string"), "content_type", "url", "relative_path")
    return rows.select("ord", line.alias("value"))


def corpus_rows(resources: DataFrame, order: str = "queue_ord") -> DataFrame:
    """Captures with ``ord`` and ``relative_path``.

    Rows that share a path share the body saved last, by ``order`` and then
    URL.  Such paths are found on narrow rows and stored: they are few, so
    rows meet them where they lie, and only their bodies are joined.
    """
    rows = with_relative_path(resources).withColumn("ord", F.col(order).cast("bigint"))
    place = F.struct("ord", "final_url")
    spark = rows.sparkSession
    shared = (
        rows.select("relative_path", "ord", "final_url")
        .groupBy("relative_path")
        .agg(F.max(place).alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("relative_path", "_last")
    )
    shared, size = write_counted(shared, new_dir(spark, "shared-paths"))
    if not size.rows:
        return rows
    small = fits_broadcast(size.bytes)
    marked = rows.join(F.broadcast(shared) if small else shared, "relative_path", "left")
    last = marked.where(place == F.col("_last")).select("relative_path", F.col("body").alias("_body")).dropDuplicates(["relative_path"])
    last, size = write_counted(last, new_dir(spark, "last-bodies"))
    joined = marked.join(F.broadcast(last) if fits_broadcast(2 * size.bytes) else last, "relative_path", "left")
    body = F.when(F.col("_last").isNotNull(), F.col("_body")).otherwise(F.col("body"))
    return joined.withColumn("body", body).select(*rows.columns)


def write_corpus(resources: DataFrame, path: str, *, mode: str = "scope", order: str = "queue_ord", cluster: bool = True) -> None:
    """Write captures sorted by host and URL within evenly hashed files.

    Rows are spread by URL, so a host with a third of all captures does not end
    up in one task, and the sort gives row groups narrow host and URL ranges
    that filters can skip.  No sampling pass reads the bodies beforehand.
    Without ``cluster`` bodies don't shuffle: rows are sorted where they are.
    """
    rows = corpus_rows(rows_to_save(resources, mode), order)
    rows = rows.withColumn("host", F.regexp_extract("final_url", "\\A[^/]*//([^/]*)", 1))
    if cluster:
        rows = rows.repartition("final_url", "ord")
    rows.sortWithinPartitions("host", "final_url").write.option("parquet.bloom.filter.enabled#final_url", "true").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Captures of a written corpus, as a replay sees them."""
    return spark.read.parquet(path).select(
        F.col("ord").alias("queue_ord"),
        F.lit("GET").alias("method"),
        F.col("final_url").alias("url"),
        "final_url",
        F.col("final_url").alias("target_url"),
        F.lit("").alias("parent_url"),
        "status",
        "content_type",
        "body",
        "relative_path",
    )
