"""The three runs: scan a crawl, scan a request list, replay a saved scan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from sievenet.operators.crawl import Crawl, crawl
from sievenet.operators.scan import scan
from sievenet.operators.scope import build_frontier
from sievenet.schemas import DEFAULT_FIELDS
from sievenet.sources.patterns import Pattern
from sievenet.sources.requests import dedup_requests, url_requests
from sievenet.sources.saved import read_saved_scans


class Run(NamedTuple):
    findings: DataFrame
    crawl: Crawl


def scan_requests(
    captures: DataFrame,
    requests: DataFrame,
    patterns: Sequence[Pattern],
    *,
    scope: str | None = None,
    dedup: bool = True,
    fields: Sequence[str] = DEFAULT_FIELDS,
    keep: Sequence[str] = (),
    **crawl_options,
) -> Run:
    """Crawl the captures from a request table and scan what is reached."""
    if not patterns:
        raise ValueError("a run needs a pattern")
    reached = crawl(captures, build_frontier(dedup_requests(requests), scope), **crawl_options)
    return Run(scan(reached.resources, patterns, dedup=dedup, fields=fields, keep=keep), reached)


def scan_url(captures: DataFrame, target: str, patterns: Sequence[Pattern], **options) -> Run:
    """Crawl and scan one target URL or scope such as ``*.example.com/*``."""
    one = captures.sparkSession.createDataFrame([(1, target)], "req_ord bigint, url string")
    return scan_requests(captures, url_requests(one), patterns, **options)


def scan_saved(
    spark: SparkSession,
    root: str,
    patterns: Sequence[Pattern],
    *,
    discover: bool = False,
    dedup: bool = True,
    fields: Sequence[str] = DEFAULT_FIELDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Replay saved scans: every body is scanned, nothing is filtered."""
    return scan(read_saved_scans(spark, root, discover=discover), patterns, dedup=dedup, fields=fields, keep=keep)
