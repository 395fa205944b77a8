"""Session settings and the few run-time checks operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

# Capture bodies reach 8 MiB, so batches handed to Python are kept short and
# input splits are left at Spark's 128 MB.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}

BROADCAST_BYTES = 64 << 20


def session(app: str = "sievenet", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="sievenet-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Size(NamedTuple):
    rows: int
    bytes: int
    """Of the rows in memory, what a broadcast moves."""


def row_bytes(value: Column, kind: DataType) -> Column:
    """Bytes of a value in a row: lengths of its strings and bodies, a word or two for anything else."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, ArrayType):
        each = F.transform(value, lambda x: row_bytes(x, kind.elementType))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("bigint"), lambda total, x: total + x), F.lit(0)) + 16
    if isinstance(kind, MapType):
        return row_bytes(F.map_keys(value), ArrayType(kind.keyType)) + row_bytes(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((row_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("bigint"))
    return F.lit(8).cast("bigint")


def write_counted(rows: DataFrame, path: str) -> tuple[DataFrame, Size]:
    """Store rows; the stored table and its size, measured while writing from lengths alone."""
    written, spark = Observation(), rows.sparkSession
    width = sum((row_bytes(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields), F.lit(16).cast("bigint"))
    rows.observe(written, F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).write.parquet(path)
    found = written.get
    return spark.read.schema(rows.schema).parquet(path), Size(found["n"], found["bytes"] or 0)


def fits_broadcast(measured: int) -> bool:
    """Size check, in measured bytes, made before every broadcast hint; larger sides join by shuffle."""
    return measured <= BROADCAST_BYTES


def spread(frame: DataFrame, key: str) -> DataFrame:
    """Redistribute rows when the input has fewer splits than there are cores.

    A few large row groups would otherwise leave cores idle.  With many splits,
    as on real captures, the frame is returned as it is and nothing shuffles.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= 2 * cores else frame.repartition(cores, key)
