"""Raw captured responses to capture rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENCODED = ("gzip", "x-gzip", "deflate")


def content_type_of(header: Column) -> Column:
    """Media type without parameters."""
    return F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1))


def _decoder(limit: int | None):
    """Function that decodes a body; null where it does not decode.

    With a limit, decoding stops one byte beyond it.  Rows go to Python in
    Spark's short batches, not in Arrow's, which by default hold 10,000 bodies.
    """

    def inflate(data, kind):
        import zlib

        if data is None:
            return None
        gzip, data, out = kind != "deflate", bytes(data), []
        room = None if limit is None else limit + 1
        while True:
            stream = zlib.decompressobj(31 if gzip else 15)
            try:
                piece = stream.decompress(data) if room is None else stream.decompress(data, room)
            except zlib.error:
                return None
            out.append(piece)
            if room is not None:
                room -= len(piece)
                if room <= 0:
                    break
            if not stream.eof:
                return None
            data = stream.unused_data
            if not data or not gzip:
                break
        return b"".join(out)

    return F.udf(inflate, "binary", useArrow=False)


def normalize_captures(raw: DataFrame, max_body: int | None = None, *, keep_undecoded: bool = False) -> DataFrame:
    """Capture rows from raw responses (``url``, ``body`` and what else is known).

    Content types lose their parameters, gzip and deflate bodies are decoded and
    missing columns get defaults.  Bodies are kept whole; with ``max_body`` they
    are cut at that many bytes and ``truncated`` tells which were.  One scan
    serves all rows, and the decoder is a column: what does not ask for bodies
    neither reads nor decodes them, if ``keep_undecoded`` is set.  Otherwise a
    body that does not decode counts as not captured and its row goes; with
    ``keep_undecoded`` it stays, with a null body.
    """
    present = set(raw.columns)

    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in present else default

    encoding = F.lower(F.trim(column("content_encoding", F.lit(""))))
    plain = F.coalesce(F.col("body").cast("binary"), F.lit(b""))
    encoded = encoding.isin(*_ENCODED)
    body = plain
    if "content_encoding" in present:
        body = F.when(encoded, _decoder(max_body)(F.when(encoded, plain), encoding)).otherwise(plain)
    known = raw.select(
        (F.col("capture_id") if "capture_id" in present else F.xxhash64("url")).alias("capture_id"),
        F.when(F.trim(column("method", F.lit(""))) == "", F.lit("GET")).otherwise(F.trim(column("method", F.lit("")))).alias("method"),
        F.col("url"),
        column("final_url", F.col("url")).alias("final_url"),
        column("target_url", F.col("url")).alias("target_url"),
        column("parent_url", F.lit("")).alias("parent_url"),
        column("status", F.lit(200)).cast("int").alias("status"),
        content_type_of(F.col("content_type") if "content_type" in present else F.lit("")).alias("content_type"),
        encoding.alias("content_encoding"),
        (F.col("headers") if "headers" in present else F.lit(None).cast("map<string,array<string>>")).alias("headers"),
        body.alias("body"),
    )
    if "content_encoding" in present and not keep_undecoded:
        known = known.where(F.col("body").isNotNull())
    if max_body is None:
        return known
    return known.withColumn("truncated", F.length("body") > max_body).withColumn("body", F.substring("body", 1, max_body))


def latest_captures(captures: DataFrame, order: str) -> DataFrame:
    """One capture per (method, url without fragment): the latest by ``order``, then ``capture_id``.

    The winners are found on keys alone; bodies move only in the final join.
    """
    from sievenet.functions.urls import without_fragment

    keyed = captures.withColumn("_key", without_fragment(F.col("url")))
    last = F.struct(F.col(order).alias("order"), F.col("capture_id").alias("id"))
    winners = keyed.groupBy("method", "_key").agg(F.max(last).alias("_last"))
    return (
        keyed.join(winners, ["method", "_key"])
        .where(last.eqNullSafe(F.col("_last")))
        .dropDuplicates(["method", "_key"])
        .select(*captures.columns)
    )
