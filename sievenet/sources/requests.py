"""Request lists: plain URLs and raw HTTP request blocks, parsed as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sievenet.functions import urls
from sievenet.functions.text import fields, trim_space
from sievenet.session import new_dir
from sievenet.sources.lines import read_lines

# Headers a followed link takes over from its parent request.
INHERITED_HEADERS = ("User-Agent", "Accept", "Accept-Language", "Accept-Encoding", "Cookie")


# Bytes of one request's lines; a longer block gets an error instead of a row too large for a task.
MAX_BLOCK = 256 << 20


def is_request_line(line: Column) -> Column:
    parts = fields(line)
    return (F.size(parts) >= 3) & F.startswith(F.upper(F.get(parts, F.lit(2))), F.lit("HTTP/"))


def canonical_header_name(name: Column) -> Column:
    """``user-agent`` to ``User-Agent``; names that are no tokens stay."""
    words = F.transform(F.split(name, "-", -1), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    return F.when(name.rlike("\\A[A-Za-z0-9!#$%&'*+\\-.^_`|~]+\\z"), F.array_join(words, "-")).otherwise(name)


def headers_of(lines: Column) -> Column:
    """Multi-valued header map of ``Name: value`` lines."""
    pairs = F.transform(
        F.filter(lines, lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            canonical_header_name(trim_space(F.substring_index(line, ":", 1))).alias("name"),
            trim_space(urls.after(line, F.substring_index(line, ":", 1), 1)).alias("value"),
        ),
    )
    grouped = F.aggregate(
        pairs,
        F.create_map().cast("map<string,array<string>>"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda name, _: name != p["name"]),
            F.create_map(
                p["name"],
                F.concat(F.coalesce(F.element_at(acc, p["name"]), F.array().cast("array<string>")), F.array(p["value"])),
            ),
        ),
    )
    return grouped


def first_header(headers: Column, name: str) -> Column:
    return F.coalesce(F.get(F.element_at(headers, name), F.lit(0)), F.lit(""))


def request_url(target: Column, host: Column) -> Column:
    """URL of a raw request, or null where the Host header is missing."""
    host = trim_space(host)
    plain_http = host.rlike("\\A(?:localhost|127\\.0\\.0\\.1):|:80\\z")
    path = F.substring_index(target, "?", 1)
    query = urls.after(target, path, 1)
    escaped = F.when(path == "*", path).otherwise(urls.encode_path(path))
    built = F.concat(
        F.when(plain_http, F.lit("http://")).otherwise(F.lit("https://")),
        urls.encode_host(host),
        F.when((path != "") & ~F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")),
        escaped,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )
    return F.when(target.rlike("\\Ahttps?://"), target).when(host != "", built)


def parse_requests(lines: DataFrame, *, strict: bool = True) -> DataFrame:
    """Requests of numbered lines (``file, chunk, line_no, value``).

    Until a file's first request line every non-blank line is a GET of that
    URL; from then on each request line opens a block of headers and body.
    Blocks are found by a running maximum inside each split plus one carried
    value per split, so no file has to pass through a single task.
    """
    marked = lines.withColumn("_start", F.when(is_request_line(F.col("value")), F.col("line_no")))
    per_split = marked.groupBy("file", "chunk").agg(F.max("_start").alias("_last"))
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_split.select("file", "chunk", F.max("_last").over(earlier).alias("_carried"))
    so_far = Window.partitionBy("file", "chunk").orderBy("line_no")
    blocks = (
        marked.withColumn("_open", F.max("_start").over(so_far))
        .join(carried, ["file", "chunk"])
        .withColumn("_block", F.coalesce("_open", "_carried"))
    )
    none = F.lit(None)
    plain = (
        blocks.where(F.col("_block").isNull())
        .select("file", "line_no", trim_space(F.col("value")).alias("url"))
        .where(F.col("url") != "")
        .select(
            F.col("file").alias("source"),
            F.col("line_no").alias("req_ord"),
            F.lit("GET").alias("method"),
            "url",
            none.cast("map<string,array<string>>").alias("headers"),
            none.cast("binary").alias("body"),
            none.cast("string").alias("error"),
        )
    )
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda r: r["value"]), "\n")
    opened = blocks.where(F.col("_block").isNotNull())
    sizes = opened.groupBy("file", "_block").agg(F.sum(F.octet_length("value") + 1).alias("_size"))
    over = sizes.where(F.col("_size") > MAX_BLOCK)
    grouped = (
        opened.join(over, ["file", "_block"], "left_anti")
        .groupBy("file", "_block")
        .agg(text.alias("_text"))
        .withColumn("_lines", F.split(trim_space(F.col("_text")), "\n", -1))
    )
    blank = F.array_position(F.transform("_lines", lambda line: trim_space(line) == ""), True)
    head = F.slice("_lines", F.lit(2), F.when(F.col("_blank") > 0, F.col("_blank") - 2).otherwise(F.size("_lines") - 1).cast("int"))
    raw = (
        grouped.withColumn("_blank", blank)
        .withColumn("_parts", fields(F.col("_lines")[0]))
        .withColumn("headers", headers_of(head))
        .withColumn("url", request_url(F.col("_parts")[1], first_header(F.col("headers"), "Host")))
        .select(
            F.col("file").alias("source"),
            F.col("_block").alias("req_ord"),
            F.upper(F.col("_parts")[0]).alias("method"),
            "url",
            "headers",
            F.when(
                F.col("_blank") > 0,
                F.array_join(F.slice("_lines", (F.col("_blank") + 1).cast("int"), F.size("_lines")), "\n"),
            ).cast("binary").alias("body"),
            F.when(F.col("url").isNull(), F.lit("a request without a Host header has no URL")).alias("error"),
        )
    )
    refused = over.select(
        F.col("file").alias("source"),
        F.col("_block").alias("req_ord"),
        none.cast("string").alias("method"),
        none.cast("string").alias("url"),
        none.cast("map<string,array<string>>").alias("headers"),
        none.cast("binary").alias("body"),
        F.concat(F.lit("a request of "), F.col("_size").cast("string"), F.lit(" bytes is too large")).alias("error"),
    )
    raw = raw.unionByName(refused)
    if strict:
        checked = F.when(F.col("error").isNull(), F.col("url")).otherwise(F.raise_error(F.col("error")).cast("string"))
        raw = raw.withColumn("url", checked)
    return plain.unionByName(raw)


def read_requests(spark: SparkSession, path: str | list[str], *, strict: bool = True) -> DataFrame:
    """Requests of one or many files, in one order: by file name, then line."""
    return in_one_order(parse_requests(read_lines(spark, path), strict=strict), ["source", "req_ord"])


def url_requests(frame: DataFrame, url: str = "url", order: str = "req_ord") -> DataFrame:
    """GET requests for a column of URLs."""
    return frame.select(
        F.lit("url").alias("source"),
        F.col(order).cast("bigint").alias("req_ord"),
        F.lit("GET").alias("method"),
        trim_space(F.col(url)).alias("url"),
        F.lit(None).cast("map<string,array<string>>").alias("headers"),
        F.lit(None).cast("binary").alias("body"),
        F.lit(None).cast("string").alias("error"),
    )


def combine_requests(*sources: DataFrame) -> DataFrame:
    """Union of request sources, numbered anew from 1: earlier sources come first, then files by name, then ``req_ord``."""
    combined = None
    for rank, frame in enumerate(sources):
        ranked = frame.withColumn("_rank", F.lit(rank))
        combined = ranked if combined is None else combined.unionByName(ranked)
    return in_one_order(combined, ["_rank", "source", "req_ord"]).drop("_rank")


def in_one_order(requests: DataFrame, order: list[str]) -> DataFrame:
    """``req_ord`` from 1 without gaps or ties in this order: ranges are sorted apart and offset."""
    spark = requests.sparkSession
    path = new_dir(spark, "requests")
    requests.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.schema(StructType([*requests.schema.fields, StructField("_part", IntegerType())])).parquet(path)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row per shuffle partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return stored.join(offsets, "_part").withColumn("req_ord", F.col("_before") + place).drop("_part", "_before")


def canonical_headers(headers: Column) -> Column:
    """Names sorted, values sorted and comma-joined: equal sets, equal text."""
    line = F.transform(
        F.array_sort(F.map_keys(headers)),
        lambda name: F.concat(name, F.lit(":"), F.array_join(F.array_sort(F.element_at(headers, name)), ","), F.lit("\n")),
    )
    return F.coalesce(F.array_join(line, ""), F.lit(""))


def dedup_requests(requests: DataFrame, order: str = "req_ord") -> DataFrame:
    """First request per (method, url, headers); the body is not compared.

    ``min_by`` combines map-side, so a request repeated in a third of all rows
    costs one row per task in the shuffle.
    """
    columns = [c for c in requests.columns]
    keyed = requests.where(trim_space(F.col("url")) != "").withColumn("_headers", canonical_headers(F.col("headers")))
    first = F.min_by(F.struct(*columns), order).alias("_row")
    return keyed.groupBy("method", "url", "_headers").agg(first).select(*(F.col(f"_row.{c}").alias(c) for c in columns))


def inherited_headers(headers: Column) -> Column:
    """Headers a followed link is requested with: first value of a fixed few."""
    kept = F.map_filter(headers, lambda name, values: name.isin(*INHERITED_HEADERS) & (F.get(values, F.lit(0)) != ""))
    return F.transform_values(kept, lambda _, values: F.slice(values, 1, 1))
