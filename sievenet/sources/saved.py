"""Saved scan folders: bodies as files, usually listed by an ``index.txt``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievenet.functions.text import content_type_from_path, trim_space
from sievenet.functions.urls import after
from sievenet.session import fits_broadcast, new_dir, write_counted
from sievenet.sources.lines import read_lines

INDEX = "index.txt"
LISTING_WAVES = 4
LISTING_CONF = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "\\A(.*)/[^/]*\\z", 1)


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Manifest rows of ``scan_dir, line_no, value`` lines.

    ``bad`` marks a row that makes its whole manifest unusable: not five
    fields, or a status that is no integer.
    """
    parts = F.col("_parts")
    return (
        lines.withColumn("_line", trim_space(F.col("value")))
        .where(F.col("_line") != "")
        .withColumn("_parts", F.split("_line", "\\t", 5))
        .select(
            "scan_dir",
            F.col("line_no").alias("queue_ord"),
            F.expr("try_cast(_parts[1] AS int)").alias("status"),
            F.get(parts, F.lit(2)).alias("content_type"),
            F.get(parts, F.lit(3)).alias("url"),
            F.get(parts, F.lit(4)).alias("relative_path"),
            (
                (F.size(parts) != 5)
                | ~F.coalesce(F.get(parts, F.lit(1)), F.lit("")).rlike("\\A[+-]?[0-9]+\\z")
            ).alias("bad"),
        )
    )


def resolve_paths(names: DataFrame, manifest_lines: DataFrame) -> DataFrame:
    """What a saved scan's captures are, decided on paths alone.

    ``names`` holds ``scan_dir, relative_path`` and further columns for every file
    of every scan, ``manifest_lines`` the numbered lines of their manifests.  A
    scan whose manifest is missing, malformed or lists an absent file is taken
    file by file instead.
    """
    rows = parse_manifest(manifest_lines)
    keys = ["scan_dir", "relative_path"]
    checked = rows.join(names.select(*keys).withColumn("_there", F.lit(True)).dropDuplicates(), keys, "left")
    broken = checked.where(F.col("bad") | F.col("_there").isNull()).select("scan_dir").distinct()
    usable = names.where(F.col("relative_path") == INDEX).select("scan_dir").distinct().join(broken, "scan_dir", "left_anti")
    listed = rows.join(broken, "scan_dir", "left_anti").join(names, keys)
    loose = (
        names.join(usable, "scan_dir", "left_anti")
        .where(file_name(F.col("relative_path")) != INDEX)
        .withColumns(
            {
                "queue_ord": F.lit(None).cast("bigint"),
                "url": F.concat(F.lit("file://"), F.col("relative_path")),
                "status": F.lit(200),
                "content_type": content_type_from_path(F.col("relative_path")),
            }
        )
    )
    return listed.select(*loose.columns).unionByName(loose)


def _captures(rows: DataFrame) -> DataFrame:
    return rows.select(
        "scan_dir",
        "queue_ord",
        F.lit("GET").alias("method"),
        "url",
        F.col("url").alias("final_url"),
        F.col("url").alias("target_url"),
        F.lit("").alias("parent_url"),
        "status",
        "content_type",
        "body",
    )


def resolve_saved_scans(files: DataFrame, manifest_lines: DataFrame) -> DataFrame:
    """Captures of saved scans given as a table of files (``scan_dir, relative_path, body``).

    The verdict is reached on paths and stored; bodies take part in one join.
    """
    keys = ["scan_dir", "relative_path"]
    spark = files.sparkSession
    chosen, size = write_counted(resolve_paths(files.select(*keys), manifest_lines), new_dir(spark, "saved-paths"))
    side = F.broadcast(chosen) if fits_broadcast(size.bytes) else chosen
    return _captures(files.select(*keys, "body").join(side, keys))


def find_scan_dirs(paths: DataFrame) -> DataFrame:
    """Scan folders (``scan_dir``) under a root, from relative file ``path`` s.

    A manifest at the root makes it the only scan.  Otherwise: the root if it
    holds files itself, each child folder holding any file, and every folder
    with a manifest, at any depth.
    """
    path = F.col("path")
    nested = F.contains(path, F.lit("/"))
    root_only = not paths.where(path == INDEX).select("path").isEmpty()
    if root_only:
        return paths.sparkSession.range(1).select(F.lit("").alias("scan_dir"))
    candidates = F.filter(
        F.array(
            F.when(~nested, F.lit("")),
            F.when(nested, F.substring_index(path, "/", 1)),
            F.when(file_name(path) == INDEX, folder_of(path)),
        ),
        lambda folder: folder.isNotNull(),
    )
    return paths.select(F.explode(F.array_distinct(candidates)).alias("scan_dir")).distinct()


def _members(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """Files of each scan folder; nested scans share files."""
    parts = F.split("path", "/", -1)
    folders = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda depth: F.array_join(F.slice(parts, F.lit(1), depth), "/"),
    )
    named = files.withColumn("scan_dir", F.explode(folders)).join(dirs, "scan_dir")
    relative = F.when(F.col("scan_dir") == "", F.col("path")).otherwise(after(F.col("path"), F.col("scan_dir"), 1))
    return named.withColumn("relative_path", relative)


def _load(spark: SparkSession, root: str, tasks: int) -> DataFrame:
    """Files below a root, listed by so many tasks at most instead of one for a few folders each."""
    before = spark.conf.get(LISTING_CONF)
    spark.conf.set(LISTING_CONF, str(min(int(before), tasks)))
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    finally:
        spark.conf.set(LISTING_CONF, before)


def read_saved_scans(spark: SparkSession, root: str, *, discover: bool = False) -> DataFrame:
    """Captures of the scan saved in ``root``, or of all scans below it.

    Which file is what capture of which scan is decided on a stored listing of
    paths.  Bodies are then read where they lie (``binaryFile``) and meet that
    table once, by path, however many scans share a file.
    """
    base = root.split("://")[-1] if root.startswith("file:") else root
    base = base.removeprefix("file:").rstrip("/") + "/"
    tasks = LISTING_WAVES * spark.sparkContext.defaultParallelism
    files = _load(spark, root, tasks)
    at = F.instr("path", base)
    listing = files.select(F.substr("path", at + F.lit(len(base))).alias("path"), F.col("path").alias("file"))
    # Small files fill splits of some thirty; as paths alone, far more fit a task and a stored part.
    listing, size = write_counted(listing.coalesce(tasks), new_dir(spark, "listing"))
    if not size.rows:
        raise ValueError(f"{root} holds no file of a saved scan")
    paths = listing.select("path")
    dirs = find_scan_dirs(paths) if discover else spark.range(1).select(F.lit("").alias("scan_dir"))
    dirs, _ = write_counted(dirs, new_dir(spark, "scan-dirs"))
    members = _members(listing, dirs)
    if paths.where(file_name(F.col("path")) == INDEX).isEmpty():
        lines = spark.createDataFrame([], "path string, line_no bigint, value string")
    else:
        lines = read_lines(spark, root, recursiveFileLookup=True, pathGlobFilter=INDEX)
        lines = lines.select(
            F.substr("file", F.instr("file", base) + F.lit(len(base))).alias("path"), "line_no", "value"
        )
    lines = lines.select(folder_of(F.col("path")).alias("scan_dir"), "line_no", "value").join(dirs, "scan_dir")
    chosen, size = write_counted(resolve_paths(members.select("scan_dir", "relative_path", "file"), lines), new_dir(spark, "saved-paths"))
    side = F.broadcast(chosen) if fits_broadcast(size.bytes) else chosen
    return _captures(files.select(F.col("path").alias("file"), F.col("content").alias("body")).join(side, "file"))
