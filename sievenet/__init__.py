"""Scan captured web corpora with Spark: patterns, links, scopes and crawls."""

from sievenet.operators.crawl import Crawl, crawl
from sievenet.operators.links import extract_links
from sievenet.operators.scan import parse_fields, scan, top_findings
from sievenet.operators.scope import build_frontier, parse_target, url_in_scope
from sievenet.plans.runs import Run, scan_requests, scan_saved, scan_url
from sievenet.session import session, spread
from sievenet.sinks.corpus import read_corpus, write_corpus
from sievenet.sinks.findings import stream_findings, write_findings, write_report
from sievenet.sources.captures import latest_captures, normalize_captures
from sievenet.sources.patterns import Pattern, assemble, find_by_names, load_patterns, packaged_patterns
from sievenet.sources.requests import combine_requests, dedup_requests, read_requests, url_requests
from sievenet.sources.saved import read_saved_scans
from sievenet.streaming.captures import stream_captures

__all__ = [name for name in dir() if not name.startswith("_")]
