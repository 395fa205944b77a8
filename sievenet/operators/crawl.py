"""Crawl over a capture table: breadth-first waves of joins, capped.

Captures are read twice in a whole crawl, whatever its depth.  A first pass
extracts the links of pages a wave could visit into a narrow edge table; waves
then join only URLs; a last pass joins the queue back to the bodies.  Queue and
edges are tables in the shared checkpoint folder, so waves have no growing
lineage and a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievenet.functions import urls
from sievenet.operators.links import with_resolved_links
from sievenet.operators.scope import admits, discovery_is_on, literal_scope, scope_matches
from sievenet.session import Size, fits_broadcast, new_dir, write_counted
from sievenet.sources.captures import latest_captures
from sievenet.sources.requests import inherited_headers

# Up to this many rows are numbered by one task; more are numbered in ranges.
ONE_TASK_ROWS = 200_000
# Edges of a bucket, about; each bucket is written by several tasks.
BUCKET_EDGES = 4_000_000
BUCKET_TASKS = 4
EVERY_ROW = (1 << 63) - 1

_QUEUE = ("queue_ord", "depth", "method", "url", "headers", "target_url", "discovered_from", "scope")


class Crawl(NamedTuple):
    queue: DataFrame
    """Every queued request in order; ``fetched`` tells first of its URL."""
    resources: DataFrame
    """Captures that were reached, with lineage and ``queue_ord``."""
    unreachable: DataFrame
    """Fetched queue rows without a capture."""
    capped: bool
    """Whether the crawl stopped at ``max_crawl`` although links were left to follow."""
    root: str
    """Folder of the crawl's stored tables; delete it when the frames are no longer used."""


def number_rows(rows: DataFrame, order: Sequence[str], start: int, limit: int, name: str = "queue_ord") -> DataFrame:
    """Dense numbers ``start+1 ...`` by ``order`` for the first ``limit`` rows.

    Small limits use a top-k and one window.  Under larger ones the rows are
    stored and counted, and numbered the same way if few.  Otherwise they are
    sorted in ranges; each range is offset by the sizes of those before it.
    """
    if limit > ONE_TASK_ROWS:
        rows, found = write_counted(rows, new_dir(rows.sparkSession, "unnumbered"))
        limit = min(limit, found.rows)
    if limit <= ONE_TASK_ROWS:
        top = rows.orderBy(*order).limit(limit)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint") + F.lit(start))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows, _ = write_counted(
        ranged.withColumn("_id", F.monotonically_increasing_id()), new_dir(rows.sparkSession, "ranges")
    )
    sorted_rows = sorted_rows.withColumn("_range", F.shiftright("_id", 33))
    counts = sorted_rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = sorted_rows.join(F.broadcast(offsets), "_range")  # one row per shuffle partition
    place = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return numbered.where(place <= limit).withColumn(name, place + F.lit(start)).drop("_id", "_range", "_first", "_before")


def fetch(queue: DataFrame, captures: DataFrame, size: Size | None = None) -> DataFrame:
    """Queue rows joined to their captures by method and fragment-free URL.

    With a measured size that allows it the queue is broadcast and the
    captures stay in place; otherwise adaptive execution picks the join.
    """
    side = queue.select(
        "queue_ord",
        "depth",
        F.col("method"),
        urls.without_fragment(F.col("url")).alias("_key"),
        F.col("url").alias("_asked"),
        F.col("target_url").alias("_target"),
        F.col("discovered_from").alias("_parent"),
    )
    if size is not None and fits_broadcast(size.bytes):
        side = F.broadcast(side)
    hit = captures.withColumn("_key", urls.without_fragment(F.col("url"))).join(side, ["method", "_key"])
    # Fragments are never sent: a page that did not redirect keeps the asked one.
    stayed = (F.col("final_url") == F.col("url")) | (F.col("final_url") == F.col("_key"))
    final = F.when(stayed, F.col("_asked")).otherwise(F.col("final_url"))
    renamed = {"url": F.col("_asked"), "final_url": final, "target_url": F.col("_target"), "parent_url": F.col("_parent")}
    columns = [renamed.get(c, F.col(c)).alias(c) for c in captures.columns if c not in ("queue_ord", "depth")]
    return hit.select("queue_ord", "depth", *columns)


def missing(queue: DataFrame, captures: DataFrame, size: Size | None = None) -> DataFrame:
    """Queue rows no capture answers.

    The queue meets the captures' keys first, so that only what is found, never
    the capture table, takes part in the anti join.
    """
    key = urls.without_fragment(F.col("url")).alias("_key")
    asked = queue.select("queue_ord", "method", key)
    if size is not None and fits_broadcast(size.bytes):
        asked = F.broadcast(asked)
    found = captures.select("method", key).join(asked, ["method", "_key"]).select("queue_ord").distinct()
    return queue.join(found, "queue_ord", "left_anti")


def _mark_first(queue: DataFrame) -> DataFrame:
    """``fetched`` is true for the first row of each URL."""
    first = queue.groupBy("url").agg(F.min("queue_ord").alias("queue_ord")).withColumn("fetched", F.lit(True))
    return queue.join(first.drop("url"), "queue_ord", "left").withColumn("fetched", F.coalesce("fetched", F.lit(False)))


def _hosts_below(hostname: Column) -> Column:
    """A host name and every suffix of whole labels, down to the empty one."""
    labels = F.split(F.lower(hostname), "\\.", -1)
    return F.transform(F.sequence(F.lit(0), F.size(labels)), lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), "."))


def _fixed_tail(scope: str) -> Column:
    """What every host of a scope ends with: the labels behind its last one that holds a ``*``."""
    labels = F.reverse(F.col(f"{scope}.host_labels"))
    open_ = F.array_position(F.transform(labels, lambda label: F.contains(label, F.lit("*"))), True)
    return F.array_join(F.reverse(F.slice(labels, 1, F.when(open_ > 0, (open_ - 1).cast("int")).otherwise(F.size(labels)))), ".")


def _reachable_pages(captures: DataFrame, seeds: DataFrame, allow_off_domain: bool) -> DataFrame:
    """Captures a wave could visit: those in some scope, and the seeds.

    Keys are chosen on narrow columns: pages meet the targets that share an
    ending of their host, then the scope test.  One target needs no join: it
    is a literal filter evaluated while captures are read.
    """
    if allow_off_domain:
        return captures
    spark = captures.sparkSession
    asked = seeds.select(urls.without_fragment(F.col("url")).alias("_key"))
    targets = seeds.select("target_url").distinct().limit(2).collect()
    keyed = captures.withColumn("_key", urls.without_fragment(F.col("url"))).withColumn("_page", urls.parts_of("_key"))
    if len(targets) == 1:
        keys, size = write_counted(asked.distinct().withColumn("_seed", F.lit(True)), new_dir(spark, "seed-keys"))
        marked = keyed.join(F.broadcast(keys) if fits_broadcast(size.bytes) else keys, "_key", "left")
        inside = scope_matches(literal_scope(spark, targets[0]["target_url"]), F.col("_page"))
        return marked.where(F.coalesce("_seed", F.lit(False)) | inside).select(*captures.columns)
    scopes = seeds.select("scope").dropDuplicates().withColumn("_tail", _fixed_tail("scope"))
    narrow = keyed.select("_key", "_page").where("_page.valid").withColumn("_tail", F.explode(_hosts_below(F.col("_page.hostname"))))
    inside = narrow.join(scopes, "_tail").where(admits("scope", "_page")).select("_key")
    keys, size = write_counted(inside.unionByName(asked).distinct(), new_dir(spark, "page-keys"))
    return keyed.join(F.broadcast(keys) if fits_broadcast(size.bytes) else keys, "_key", "left_semi").select(*captures.columns)


def build_edges(captures: DataFrame, out_scope: Sequence[str] = ()) -> DataFrame:
    """Narrow link table: page key, page URL and each link it holds.

    Rows without links go behind the explode.  A plain one makes Spark test in front of it whether there are links,
    which finds them twice and parses the page's URL for each of them.
    """
    pages = captures.select("method", "url", "final_url", "content_type", "body")
    linked = with_resolved_links(pages, out_scope)
    key = urls.without_fragment(F.col("url"))
    return (
        linked.select("method", key.alias("page"), "url", "final_url", F.posexplode_outer("links").alias("link_ord", "link"))
        .where(F.col("link_ord").isNotNull())
        .select(
            "method",
            "page",
            ((F.col("final_url") == F.col("url")) | (F.col("final_url") == F.col("page"))).alias("stayed"),
            "final_url",
            "link_ord",
            F.col("link.url").alias("link_url"),
            F.struct("link.hostname", "link.port", "link.scheme", "link.escaped_path").alias("parts"),
            F.col("link.relevant").alias("relevant"),
            F.col("link.same_page").alias("same_page"),
        )
    )


def edge_bucket(page: Column, buckets: int) -> Column:
    return F.pmod(F.hash(page), F.lit(buckets))


def write_edges(captures: DataFrame, path: str, out_scope: Sequence[str] = ()) -> DataFrame:
    """Store the edge table, partitioned by a hash of the page, and read it back.

    The extraction stage writes with its own parallelism and measures how many
    edges there are.  If they are many the narrow table is dealt to buckets,
    each written by several tasks, so that dynamic partition pruning lets a small
    wave read only the buckets its pages fall in.
    """
    spark = captures.sparkSession
    found, size = write_counted(build_edges(captures, out_scope), f"{path}/found")
    buckets = max(1, size.rows // BUCKET_EDGES)
    bucketed = found.withColumn("buckets", F.lit(buckets)).withColumn("bucket", edge_bucket(F.col("page"), buckets))
    if buckets == 1:
        return bucketed
    salted = bucketed.repartition(buckets * BUCKET_TASKS, "bucket", F.pmod(F.hash("link_url"), F.lit(BUCKET_TASKS)))
    salted.write.partitionBy("buckets", "bucket").parquet(f"{path}/buckets")
    return spark.read.schema(bucketed.schema).parquet(f"{path}/buckets")


def _stored_buckets(edges: DataFrame) -> int | None:
    row = edges.select("buckets").first() if "buckets" in edges.columns else None
    return row["buckets"] if row else None


def _children(wave: DataFrame, edges: DataFrame, buckets: int | None, size: Size, allow_off_domain: bool) -> DataFrame:
    """Links of a wave's pages that its scopes admit, one row per new URL."""
    page = urls.without_fragment(F.col("url"))
    keys = ["method", "page"]
    bucket = []
    if buckets:
        bucket = [edge_bucket(page, buckets).alias("bucket")]
        keys.append("bucket")
    parents = wave.select(
        *bucket,
        F.col("method"),
        page.alias("page"),
        F.col("url").alias("_asked"),
        F.col("queue_ord").alias("_parent"),
        "scope",
    )
    small = fits_broadcast(size.bytes)
    found = edges.join(F.broadcast(parents) if small else parents, keys).where(F.col("scope.wildcard") | F.col("relevant"))
    if not allow_off_domain:
        found = found.where(admits("scope", "parts"))
    fragment = urls.after(F.col("_asked"), F.col("page"))
    here = F.when(F.col("stayed"), F.col("_asked")).otherwise(F.col("final_url"))
    own = F.col("same_page") & F.col("stayed") & (fragment != "") & ~F.contains("link_url", F.lit("#"))
    url = F.when(own, F.concat("link_url", fragment)).otherwise(F.col("link_url"))
    links = found.select(url.alias("url"), F.struct("_parent", "link_ord", here.alias("discovered_from")).alias("_first"))
    first = links.groupBy("url").agg(F.min("_first").alias("_first")).select("url", "_first.*")
    inherited = wave.select(
        F.col("queue_ord").alias("_parent"), inherited_headers(F.col("headers")).alias("headers"), "target_url", "scope"
    )
    return first.join(F.broadcast(inherited) if small else inherited, "_parent")


def _wave(numbered: DataFrame, depth: int) -> DataFrame:
    """Queue rows of numbered children."""
    return numbered.select(
        "queue_ord",
        F.lit(depth).alias("depth"),
        F.lit("GET").alias("method"),
        "url",
        "headers",
        "target_url",
        "discovered_from",
        "scope",
        F.lit(True).alias("fetched"),
    )


def crawl(
    captures: DataFrame,
    frontier: DataFrame,
    *,
    discover: bool = False,
    allow_off_domain: bool = False,
    out_scope: Sequence[str] = (),
    max_crawl: int | None = None,
    edges: DataFrame | None = None,
    strict: bool = False,
    order: str = "capture_id",
) -> Crawl:
    """Follow links from a seed queue through the captures.

    ``frontier`` comes from :func:`sievenet.operators.scope.build_frontier`.
    Waves reproduce first-in-first-out order: children are numbered by parent
    and link position.  By default links are followed to the end; with
    ``max_crawl`` none is queued once that many requests are, and the result's
    ``capped`` tells if that cut anything off.  A wildcard target turns
    discovery on.  Of several captures of a method and URL without fragment
    the latest by the column ``order`` is taken.  ``edges`` reuses a stored edge
    table.  ``strict`` fails the run when a seed is missing and discovery is off.
    """
    if max_crawl is not None and max_crawl <= 0:
        raise ValueError(f"a crawl needs room for one request at least, not {max_crawl}")
    spark = captures.sparkSession
    key = urls.without_fragment(F.col("url")).alias("key")
    if not captures.select("method", key).groupBy("method", "key").count().where("count > 1").isEmpty():
        captures = latest_captures(captures, order)
    root = new_dir(spark, "crawl")

    def wave_path(depth: int) -> str:
        return f"{root}/queue/wave={depth}"

    def stored(last: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*(wave_path(d) for d in range(last + 1)))

    def store(rows: DataFrame, depth: int) -> tuple[DataFrame, Size]:
        return write_counted(rows, wave_path(depth))

    seeds, given = write_counted(frontier.select(*_QUEUE, "seed_ord"), f"{root}/seeds")
    first = _mark_first(number_rows(seeds, ["queue_ord", "seed_ord"], 0, given.rows)).select(*_QUEUE, "fetched")
    schema = first.schema
    wave, size = store(first, 0)
    queued, weight = size
    discover = discover or discovery_is_on(wave)
    depth, capped = 0, False
    if discover and edges is None:
        edges = write_edges(_reachable_pages(captures, wave, allow_off_domain), f"{root}/edges", out_scope)
    buckets = _stored_buckets(edges) if discover else None
    while discover and size.rows:
        seen = stored(depth).select("url")
        fresh = _children(wave.where("fetched"), edges, buckets, size, allow_off_domain).join(seen, "url", "left_anti")
        left = None if max_crawl is None else max_crawl - queued
        if left is not None and left <= 0:
            capped = not fresh.isEmpty()
            break
        depth += 1
        limit = EVERY_ROW if left is None else left + 1  # one more tells whether the cap cuts
        numbered = number_rows(fresh, ("_parent", "link_ord"), queued, limit)
        found = _wave(numbered, depth)
        if left is not None:
            found, _ = write_counted(found, f"{root}/found/wave={depth}")
            capped = not found.where(F.col("queue_ord") > max_crawl).isEmpty()
            found = found.where(F.col("queue_ord") <= max_crawl)
        wave, size = store(found, depth)
        queued, weight = queued + size.rows, weight + size.bytes
        if capped:
            break
    queue = stored(depth)
    asked = queue.where("fetched").drop("fetched")
    whole = Size(queued, weight)
    unreachable = missing(asked, captures, whole)
    if strict and not discover and not unreachable.isEmpty():
        raise ValueError("discovery is off and some seed was never captured")
    return Crawl(queue, fetch(asked, captures, whole), unreachable, capped, root)
