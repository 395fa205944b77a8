"""Captures as a stream.  A scan keeps no state, so it runs on one unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievenet.sources.captures import normalize_captures


def stream_captures(spark: SparkSession, path: str, schema, source: str = "parquet", **options) -> DataFrame:
    """Capture rows of files as they arrive in ``path``."""
    raw = spark.readStream.format(source).schema(schema).options(**options).load(path)
    return normalize_captures(raw)
