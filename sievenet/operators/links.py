"""Link discovery: candidates of a body, cleaned, resolved and filtered.

Everything happens inside the row of the page, in array expressions, so that
the per-page dedup needs no shuffle and pages never leave their partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievenet.functions import text as T
from sievenet.functions import urls
from sievenet.functions.built import built_once
from sievenet.functions.html import html_links
from sievenet.functions.regex import to_spark_regex
from sievenet.operators.outscope import out_of_scope
from sievenet.operators.scope import literal_scope, scope_matches

# Link shapes looked for in text bodies, in order.
TEXT_LINK_PATTERNS = (
    r"""https?://[^\s"'<>\\]+""",
    r"""(?:src|href|url)\s*[:=]\s*["']([^"']+)["']""",
    r"""["']([^"']+\.(?:js|json|xml|map)(?:\?[^"']*)?)["']""",
    r"""["']((?:/|\./|\.\./)[^"']+)["']""",
    r"""sourceMappingURL=([^\s"'<>]+)""",
)

# Never followed, whatever the scope.
SKIPPED_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp",
    ".mp4", ".mov", ".avi", ".mp3", ".wav", ".woff",
    ".woff2", ".ttf", ".eot", ".ico", ".pdf",
)

# What makes a link worth following in a literal scope.
RELEVANT_EXTENSIONS = (".js", ".json", ".xml", ".map", ".txt", ".conf", ".config")
RELEVANT_PATH_WORDS = ("api", "graphql", "swagger", "openapi")
RELEVANT_QUERY_WORDS = ("json", "graphql", "swagger", "openapi")


def is_html(content_type: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("html"))


def is_text_discoverable(content_type: Column, final_url: Column) -> Column:
    return F.lower(content_type).rlike("html|javascript|json|xml|text") | T.extension(final_url).isin(
        ".js", ".json", ".xml", ".map", ".txt"
    )


def text_links(body: Column) -> Column:
    """Raw candidates of the text patterns over a whole body, in order."""
    found = []
    for source in TEXT_LINK_PATTERNS:
        java = to_spark_regex(source).java
        matches = F.regexp_extract_all(body, F.lit(java), F.lit(0))
        has_group = "(" in source.replace("(?", "")
        found.append(F.transform(matches, _inner_value(java)) if has_group else matches)
    return F.concat(*found)


def _inner_value(java: str):
    """The group of a match, or the match where the group is blank."""

    def inner(match: Column) -> Column:
        group = F.regexp_extract(match, java, 1)
        return F.when(T.trim_space(group) != "", group).otherwise(match)

    return inner


def clean_candidate(raw: Column) -> Column:
    """Trim space and quotes, then one trailing ``\\``, ``;`` and ``,``."""
    return F.regexp_replace(F.btrim(T.trim_space(raw), F.lit("\"'")), ",?;?\\\\?\\z", "")


def candidates(body: Column, content_type: Column, final_url: Column) -> Column:
    """Distinct cleaned candidates of a body, HTML links before text links."""
    none = F.array().cast("array<string>")
    raw = F.concat(
        F.when(is_html(content_type), html_links(body)).otherwise(none),
        F.when(is_text_discoverable(content_type, final_url), text_links(body)).otherwise(none),
    )
    return F.array_distinct(F.filter(F.transform(raw, clean_candidate), lambda c: c != ""))


def is_skipped(path: Column) -> Column:
    return T.extension(path).isin(*SKIPPED_EXTENSIONS)


def is_relevant(path: Column, query: Column) -> Column:
    return (
        T.extension(path).isin(*RELEVANT_EXTENSIONS)
        | F.lower(path).rlike("|".join(RELEVANT_PATH_WORDS))
        | F.lower(query).rlike("|".join(RELEVANT_QUERY_WORDS))
    )


@built_once
def _stages(out_scope: tuple[str, ...]) -> tuple[Column, Column]:
    found = candidates(F.col("_text"), F.col("content_type"), F.col("final_url"))
    resolved = urls.resolve_all(F.col("_base"), F.when(F.col("_base.valid"), F.col("_refs")))
    kept = F.filter(
        resolved,
        lambda link: ~is_skipped(link["path"]) & ~out_of_scope(out_scope, link["url"], link["path"]),
    )
    return found, F.transform(kept, lambda link: link.withField("relevant", is_relevant(link["path"], link["query"])))


def with_resolved_links(captures: DataFrame, out_scope: Sequence[str] = (), name: str = "links") -> DataFrame:
    """Add an array of resolved links to every capture.

    Excluded and media URLs are gone; ``relevant`` marks links a literal scope
    follows.  Staged in projections so that the base URL is parsed once.
    """
    columns = captures.columns
    found, links = _stages(tuple(out_scope))
    return (
        captures.select(*columns, urls.parts_of("final_url").alias("_base"), T.as_text(F.col("body")).alias("_text"))
        .select(*columns, "_base", found.alias("_refs"))
        .select(*columns, links.alias(name))
    )


def extract_links(
    captures: DataFrame,
    scope: str | None = None,
    *,
    out_scope: Sequence[str] = (),
    allow_off_domain: bool = False,
    aggressive: bool | None = None,
    keep: Sequence[str] = ("capture_id",),
) -> DataFrame:
    """Links found in each capture: ``keep``, ``url, discovered_from, link_ord``.

    ``aggressive`` follows irrelevant-looking links too; by default that is so
    when the scope holds a ``*``.
    """
    if aggressive is None:
        aggressive = bool(scope and "*" in scope)
    rows = with_resolved_links(captures.select(*dict.fromkeys([*keep, "final_url", "content_type", "body"])), out_scope)
    links = F.col("links")
    if scope and not allow_off_domain:
        target = literal_scope(captures.sparkSession, scope)
        links = F.filter(links, lambda link: scope_matches(target, link))
    if not aggressive:
        links = F.filter(links, lambda link: link["relevant"])
    distinct = F.array_distinct(F.transform(links, lambda link: link["url"]))
    return rows.select(
        *keep, F.col("final_url").alias("discovered_from"), F.posexplode(distinct).alias("link_ord", "url")
    ).select(*keep, "url", "discovered_from", "link_ord")
