"""Schemas of the tables that flow between operators."""

from __future__ import annotations

HEADERS = "map<string,array<string>>"

REQUESTS = f"source string, req_ord bigint, method string, url string, headers {HEADERS}, body binary"

CAPTURES = (
    "capture_id bigint, method string, url string, final_url string, target_url string, parent_url string, "
    f"status int, content_type string, content_encoding string, headers {HEADERS}, body binary"
)

PATTERNS = "pattern_ord int, name string, regex string, description string, source string"

SCOPE = (
    "struct<raw:string,schemes:array<string>,host_exact:string,host_labels:array<string>,port:string,"
    "path_pattern:string,path_regex:string,wildcard:boolean,seeds:array<string>,error:string>"
)

FRONTIER = (
    f"queue_ord bigint, seed_ord int, depth int, method string, url string, headers {HEADERS}, "
    f"target_url string, discovered_from string, scope {SCOPE}"
)

MANIFEST = "ord bigint, status int, content_type string, url string, relative_path string"

FINDING_FIELDS = (
    "pattern",
    "pattern_name",
    "pattern_source",
    "matched_value",
    "context",
    "target_url",
    "resource_url",
    "resource_kind",
    "discovered_from",
    "line",
    "status",
    "content_type",
)

DEFAULT_FIELDS = ("pattern", "pattern_name", "resource_url", "matched_value")
