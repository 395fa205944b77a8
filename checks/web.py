"""Checks of URLs, links, scopes, requests, crawls and save paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import tables as t
from checks.scans import _PATHS, _paths, ext_sql
from sievenet.functions import urls
from sievenet.functions.html import html_links
from sievenet.operators.crawl import crawl
from sievenet.operators.links import (
    RELEVANT_EXTENSIONS,
    SKIPPED_EXTENSIONS,
    TEXT_LINK_PATTERNS,
    clean_candidate,
    extract_links,
    is_skipped,
    is_text_discoverable,
    text_links,
)
from sievenet.operators.outscope import CATEGORIES, out_of_scope
from sievenet.operators.scope import build_frontier, scope_of, where_in_scope
from sievenet.sinks.corpus import manifest, manifest_lines, rows_to_save
from sievenet.functions.paths import with_relative_path
from sievenet.sources.requests import dedup_requests, inherited_headers, parse_requests, request_url, url_requests

QUERIES, ORACLES = {}, {}
ID = "capture_id"


def check(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


ORIGIN = "regexp_extract(url, '^(https?://[^/]+)', 1)"
HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
BARE = "regexp_replace(url, '[?#].*$', '')"
FOLDER = f"regexp_extract({BARE}, '^(.*/)[^/]*$', 1)"
DOMAIN = "regexp_extract(url, '^https?://[^.]+[.]([^/]+)', 1)"
HREF = '<a href="([^"]*)"'
HREFS_SQL = f"hrefs AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages)"


def _hrefs(spark, sf):
    found = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return t.read(spark, sf, "pages").select("page_id", "url", F.explode(found).alias("href"))


# -- URL expressions ---------------------------------------------------------

_PORTED = f"concat(regexp_extract(url, '^(https?)', 1), '://', {HOST}, CASE WHEN page_id % 2 = 0 THEN ':8080' ELSE '' END, regexp_extract(url, '^https?://[^/]+(.*)$', 1))"
check(
    "url_parts",
    f"""WITH u AS (SELECT page_id, url, {_PORTED} AS full_url FROM pages)
  SELECT page_id, regexp_extract(full_url, '^([a-z]+):', 1) AS scheme, regexp_extract(full_url, '//([^/]+)', 1) AS host, {HOST} AS hostname,
    CASE WHEN page_id % 2 = 0 THEN '8080' ELSE '' END AS port, regexp_extract(full_url, '//[^/]+([^?#]*)', 1) AS path,
    regexp_extract(full_url, '[?]([^#]*)', 1) AS query, regexp_extract(full_url, '#(.*)$', 1) AS fragment FROM u""",
)(
    lambda spark, sf: t.read(spark, sf, "pages")
    .select("page_id", F.expr(_PORTED).alias("full_url"))
    .select("page_id", urls.parts_of("full_url").alias("p"))
    .select("page_id", *(F.col(f"p.{n}").alias(n) for n in ("scheme", "host", "hostname", "port", "path", "query", "fragment")))
)

_WORD = "substr(href, 2)"
_FORM = "CAST((page_id + length(href)) % 6 AS INT)"
_REFERENCE = f"""CASE {_FORM} WHEN 0 THEN {_WORD} WHEN 1 THEN concat('../', {_WORD}) WHEN 2 THEN concat('./x/../', {_WORD})
  WHEN 3 THEN concat('?q=', {_WORD}) WHEN 4 THEN concat('#', {_WORD}) ELSE concat('//Other.test/', {_WORD}) END"""
check(
    "url_resolve",
    f"""WITH {HREFS_SQL} SELECT page_id, {_REFERENCE} AS reference, CASE {_FORM} WHEN 1 THEN concat(regexp_replace({FOLDER}, '[^/]+/$', ''), {t.escaped_path(_WORD)})
    WHEN 3 THEN concat({BARE}, '?q=', {_WORD}) WHEN 4 THEN concat(regexp_replace(url, '#.*$', ''), '#', {t.escaped_path(_WORD)})
    WHEN 5 THEN concat(regexp_extract(url, '^(https?)', 1), '://Other.test/', {t.escaped_path(_WORD)})
    ELSE concat({FOLDER}, {t.escaped_path(_WORD)}) END AS resolved FROM hrefs""",
)(
    lambda spark, sf: _hrefs(spark, sf)
    .select("page_id", "url", F.expr(_REFERENCE).alias("reference"))
    .select("page_id", "reference", urls.resolve(F.col("url"), F.col("reference")).alias("resolved"))
)
check(
    "url_escape",
    f"""WITH {HREFS_SQL} SELECT page_id, href, CASE WHEN page_id % 2 = 0 THEN concat('/a%20b/', {t.escaped_path(_WORD)}, 'A/x') ELSE {t.escaped_path('href')} END AS path FROM hrefs""",
)(
    lambda spark, sf: _hrefs(spark, sf).select(
        "page_id", "href", urls.escape_path(F.expr(f"CASE WHEN page_id % 2 = 0 THEN concat('/a b/', {_WORD}, '%41/x') ELSE href END")).alias("path")
    )
)

# -- links -------------------------------------------------------------------

_LINK_SOURCE = f"src AS (SELECT page_id, url, html, {t.LINK_BODY} AS body FROM pages)"
_HTML_LIST = f"""list_concat(['/assets/app-' || page_id || '.js?v=1&w=2'], regexp_extract_all(html, '{HREF}', 1),
  ['/data/' || page_id || '.json', 'img/p' || page_id || '.png'])"""


def _text_list() -> str:
    lists = []
    for source in TEXT_LINK_PATTERNS:
        whole = f"regexp_extract_all(body, {t.quoted(source)})"
        if "(" not in source.replace("(?", ""):
            lists.append(whole)
            continue
        inner = f"regexp_extract_all(body, {t.quoted(source)}, 1)"
        lists.append(f"[CASE WHEN trim(z[2]) <> '' THEN z[2] ELSE z[1] END FOR z IN list_zip({whole}, {inner})]")
    return "list_concat(" + ", ".join(lists) + ")"


def _numbered(expression: str, name: str) -> str:
    return f"unnest({expression}) AS {name}, CAST(unnest(generate_series(0, len({expression}) - 1)) AS INT) AS pos"


check("links_html", f"WITH {_LINK_SOURCE} SELECT page_id, {_numbered(_HTML_LIST, 'link')} FROM src")(
    lambda spark, sf: t.html_pages(spark, sf).select(
        F.col(ID).alias("page_id"), F.posexplode(html_links(F.col("body").cast("string"))).alias("pos", "link")
    )
)
check("links_text", f"WITH {_LINK_SOURCE} SELECT page_id, {_numbered(_text_list(), 'link')} FROM src")(
    lambda spark, sf: t.html_pages(spark, sf).select(
        F.col(ID).alias("page_id"), F.posexplode(text_links(F.col("body").cast("string"))).alias("pos", "link")
    )
)


def clean_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(trim(trim({x}), '\"'''), '[\\\\]$', ''), ';$', ''), ',$', '')"


_NOISY = """concat(CASE CAST(length(href) % 3 AS INT) WHEN 0 THEN ' "' WHEN 1 THEN '''' ELSE '' END, href,
  CASE CAST(page_id % 4 AS INT) WHEN 0 THEN concat(',;', chr(92)) WHEN 1 THEN '";, ' WHEN 2 THEN ',,' ELSE '' END)"""
check("links_clean", f"WITH {HREFS_SQL} SELECT page_id, noisy, {clean_sql('noisy')} AS link FROM (SELECT page_id, {_NOISY} AS noisy FROM hrefs)")(
    lambda spark, sf: _hrefs(spark, sf)
    .select("page_id", F.expr(_NOISY).alias("noisy"))
    .select("page_id", "noisy", clean_candidate(F.col("noisy")).alias("link"))
)

_PATH_PART = "regexp_extract(c, '^([^?#]*)', 1)"
_TAIL = "substr(c, length(regexp_extract(c, '^([^?#]*)', 1)) + 1)"
_RELATIVE = "regexp_replace(regexp_extract(c, '^([^?#]*)', 1), '^[.]/', '')"
LINKS_SQL = f"""{_LINK_SOURCE}, cands AS (SELECT page_id, url, {_numbered(f'list_concat({_HTML_LIST}, {_text_list()})', 'raw')} FROM src),
  cleaned AS (SELECT page_id, url, pos, {clean_sql('raw')} AS c FROM cands),
  resolved AS (SELECT page_id, url AS page_url, pos, CASE WHEN regexp_matches(c, '^https?://') THEN c
    WHEN starts_with(c, '/') THEN concat({ORIGIN}, {t.escaped_path(_PATH_PART)}, {_TAIL})
    ELSE concat({FOLDER}, {t.escaped_path(_RELATIVE)}, {_TAIL}) END AS url FROM cleaned WHERE c <> ''),
  split AS (SELECT *, {ext_sql("regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)")} AS ext, lower(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1)) AS path,
    lower(regexp_extract(url, '[?]([^#]*)', 1)) AS query FROM resolved),
  media AS (SELECT * FROM split WHERE ext NOT IN {SKIPPED_EXTENSIONS})"""


def links_sql(where: str) -> str:
    return f"""WITH {LINKS_SQL}, firsts AS (SELECT page_id, page_url, url, min(pos) AS p FROM media WHERE {where} GROUP BY ALL)
  SELECT page_id AS capture_id, url, page_url AS discovered_from, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INT) AS link_ord FROM firsts"""


_RELEVANT = f"(ext IN {RELEVANT_EXTENSIONS} OR regexp_matches(path, 'api|graphql|swagger|openapi') OR regexp_matches(query, 'json|graphql|swagger|openapi'))"
_IN_DOMAIN = "regexp_matches(url, '^https?://[^/.]+[.][^/.]+[.]example[.]com(/|$)')"
check("links_distinct", links_sql("true"))(lambda spark, sf: extract_links(t.html_pages(spark, sf), aggressive=True))
check("links_relevant", links_sql(_RELEVANT))(lambda spark, sf: extract_links(t.html_pages(spark, sf)))
check("links_scope", links_sql(_IN_DOMAIN))(lambda spark, sf: extract_links(t.html_pages(spark, sf), "*.*.example.com"))
check(
    "links_outscope",
    links_sql("ext NOT IN " + str(CATEGORIES["images"]) + " AND NOT (lower(url) LIKE '%cdn.test%') AND NOT (lower(url) LIKE 'http://%/data/%')"),
)(lambda spark, sf: extract_links(t.html_pages(spark, sf), aggressive=True, out_scope=["images", "image", "*CDN.test*", "http://*/data/*"]))
check(
    "links_resolve",
    f"WITH {LINKS_SQL} SELECT DISTINCT page_id AS capture_id, url FROM media WHERE {_RELEVANT} OR starts_with(url, 'https://cdn.test')",
)(
    lambda spark, sf: extract_links(t.html_pages(spark, sf), "https://cdn.test", allow_off_domain=True).select(ID, "url")
)

_MEDIA = "concat(regexp_replace(url, '[?#].*$', ''), '.', CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'PNG' WHEN 1 THEN 'woff2' WHEN 2 THEN 'html' WHEN 3 THEN 'pdf' WHEN 4 THEN 'webm' ELSE 'css' END)"
check("links_media", f"SELECT page_id, path, {ext_sql('path')} IN {SKIPPED_EXTENSIONS} AS skipped FROM (SELECT page_id, {_MEDIA} AS path FROM pages)")(
    lambda spark, sf: t.read(spark, sf, "pages")
    .select("page_id", F.expr(_MEDIA).alias("path"))
    .select("page_id", "path", is_skipped(F.col("path")).alias("skipped"))
)


def _outscope(rules):
    return lambda spark, sf: (
        t.read(spark, sf, "pages")
        .select("page_id", F.expr(_MEDIA).alias("path"))
        .select("page_id", out_of_scope(rules, F.col("path"), F.col("path")).alias("excluded"))
    )


check(
    "outscope_category",
    f"SELECT page_id, {ext_sql('path')} IN {CATEGORIES['images'] + CATEGORIES['css'] + CATEGORIES['video']} AS excluded FROM (SELECT page_id, {_MEDIA} AS path FROM pages)",
)(_outscope(["Images", "css", "video"]))
check(
    "outscope_wildcard",
    f"SELECT page_id, lower(path) LIKE '%.example.com/en/%' OR lower(path) LIKE 'http://%.png' AS excluded FROM (SELECT page_id, {_MEDIA} AS path FROM pages)",
)(_outscope(["*.Example.com/EN/*", "http://*.png", "image"]))
check(
    "text_discoverable",
    f"""SELECT page_id, regexp_matches(lower(content_type), 'html|javascript|json|xml|text') OR ext IN ('.js', '.json', '.xml', '.map', '.txt') AS discoverable
  FROM (SELECT page_id, {t.SQL_TYPE} AS content_type, {ext_sql('p')} AS ext FROM (SELECT *, {_PATHS} AS p FROM pages))""",
)(
    lambda spark, sf: t.pages(spark, sf)
    .join(_paths(spark, sf).withColumnRenamed("page_id", ID), ID)
    .select(F.col(ID).alias("page_id"), is_text_discoverable(F.col("content_type"), F.col("path")).alias("discoverable"))
)

# -- scopes ------------------------------------------------------------------

_TARGET = f"""CASE CAST(page_id % 4 AS INT) WHEN 0 THEN upper({HOST}) WHEN 1 THEN concat('http://', {HOST}, ':8080/en/*')
  WHEN 2 THEN concat('*.', {DOMAIN}) ELSE concat(' ', {BARE}, ' ') END"""
_TARGETS_SQL = f"tg AS (SELECT page_id, url, CAST(page_id % 4 AS INT) AS k, {_TARGET} AS target FROM pages)"


def _targets(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", "url", F.expr(_TARGET).alias("target")).withColumn("scope", scope_of("target"))


check(
    "scope_parse",
    f"""WITH {_TARGETS_SQL} SELECT page_id, trim(target) AS raw, CASE k WHEN 1 THEN 'http' WHEN 3 THEN regexp_extract(url, '^(https?)', 1) ELSE 'https,http' END AS schemes,
    CASE k WHEN 2 THEN concat('*.', {DOMAIN}) ELSE {HOST} END AS host_exact, CASE k WHEN 1 THEN '8080' ELSE '' END AS port,
    CASE k WHEN 1 THEN '/en/*' WHEN 3 THEN regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) ELSE '/*' END AS path_pattern,
    CAST(len(string_split({HOST}, '.')) AS INT) AS labels, k IN (1, 2) AS wildcard FROM tg""",
)(
    lambda spark, sf: _targets(spark, sf).select(
        "page_id",
        "scope.raw",
        F.array_join("scope.schemes", ",").alias("schemes"),
        "scope.host_exact",
        "scope.port",
        "scope.path_pattern",
        F.size("scope.host_labels").alias("labels"),
        "scope.wildcard",
    )
)
_SEEDS_SQL = f"""{_TARGETS_SQL}, schemes AS (SELECT *, CASE k WHEN 1 THEN ['http'] WHEN 3 THEN [regexp_extract(url, '^(https?)', 1)] ELSE ['https', 'http'] END AS s FROM tg),
  seeds AS (SELECT page_id, trim(target) AS target_url, unnest(s) AS scheme, unnest(generate_series(0, len(s) - 1)) AS i, k, url FROM schemes),
  seeded AS (SELECT page_id, target_url, i, concat(scheme, '://', CASE k WHEN 0 THEN concat({HOST}, '/') WHEN 1 THEN concat({HOST}, ':8080/en/')
    WHEN 2 THEN concat({DOMAIN}, '/') ELSE regexp_extract(url, '^https?://([^?#]+)', 1) END) AS seed FROM seeds)"""
check("scope_seeds", f"WITH {_SEEDS_SQL} SELECT page_id, CAST(i AS INT) AS pos, seed FROM seeded")(
    lambda spark, sf: _targets(spark, sf).select("page_id", F.posexplode("scope.seeds").alias("pos", "seed"))
)
check("seed_queue", f"WITH {_SEEDS_SQL} SELECT hash_of AS queue_ord, CAST(i AS INT) AS seed_ord, seed AS url, target_url, 'GET' AS method FROM (SELECT *, page_id * 1000003 + 9000000000000000000 AS hash_of FROM seeded)")(
    lambda spark, sf: build_frontier(url_requests(_targets(spark, sf).withColumn("order", F.col("page_id") * 1000003 + 9000000000000000000), "target", "order")).select("queue_ord", "seed_ord", "url", "target_url", "method")
)
_CANDIDATE = "CASE CAST(page_id % 3 AS INT) WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://x.') ELSE replace(url, '://', '://u@') END"
_SCOPE = f"concat('*.', {DOMAIN}, CASE WHEN page_id % 2 = 0 THEN '/en/*' ELSE '' END)"
check(
    "scope_match",
    f"SELECT page_id, {_CANDIDATE} AS candidate FROM pages WHERE page_id % 3 <> 1 AND (page_id % 2 = 1 OR regexp_matches(url, '^https?://[^/]+/en/'))",
)(
    lambda spark, sf: where_in_scope(
        t.read(spark, sf, "pages")
        .select("page_id", F.expr(_CANDIDATE).alias("candidate"), F.expr(_SCOPE).alias("target"))
        .withColumn("scope", scope_of("target")),
        "scope",
        "candidate",
    ).select("page_id", "candidate")
)

# -- requests ----------------------------------------------------------------

_BLOCK = f"""array(concat('post /p/', page_id, '?x=', page_id, ' HTTP/1.1'), concat('host: ', {HOST}), concat('x-id: ', page_id), 'X-ID: again', 'no colon', '', concat('body ', page_id), '', 'tail ')"""


def _request_lines(spark, sf):
    """Per file: plain URLs in one, raw request blocks in the others; in splits."""
    rows = t.read(spark, sf, "pages").withColumn("file", F.expr("concat('f', page_id % 5)"))
    lines = F.when(F.col("file") == "f0", F.array(F.concat(F.lit("  "), "url"), F.lit(""))).otherwise(F.expr(_BLOCK))
    return rows.select("page_id", "file", F.posexplode(lines).alias("_at", "value")).select(
        "file", F.expr("(page_id * 10 + _at) div 64").alias("chunk"), (F.col("page_id") * 10 + F.col("_at")).alias("line_no"), "value"
    )


check(
    "request_parse",
    f"""SELECT concat('f', page_id % 5) AS source, CASE WHEN page_id % 5 = 0 THEN 'GET' ELSE 'POST' END AS method,
    CASE WHEN page_id % 5 = 0 THEN url ELSE concat('https://', {HOST}, '/p/', page_id, '?x=', page_id) END AS url,
    CASE WHEN page_id % 5 = 0 THEN NULL ELSE concat(page_id, ',again') END AS ids,
    CASE WHEN page_id % 5 = 0 THEN NULL ELSE concat('body ', page_id, chr(10), chr(10), 'tail') END AS body FROM pages""",
)(
    lambda spark, sf: parse_requests(_request_lines(spark, sf)).select(
        "source", "method", "url", F.array_join(F.element_at("headers", "X-Id"), ",").alias("ids"), F.col("body").cast("string").alias("body")
    )
)
_RAW_TARGET = f"CASE CAST(page_id % 3 AS INT) WHEN 0 THEN url WHEN 1 THEN concat('/a b/', page_id, '%20?q=', page_id) ELSE concat('x', page_id) END"
_RAW_HOST = f"CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'localhost:8080' WHEN 1 THEN concat({HOST}, ':80') WHEN 2 THEN '' ELSE concat(' ', {HOST}) END"
check(
    "request_url",
    f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN h = '' THEN NULL ELSE concat(CASE WHEN page_id % 4 IN (0, 1) THEN 'http://' ELSE 'https://' END, h,
    CASE WHEN page_id % 3 = 1 THEN concat('/a%20b/', page_id, '%2520?q=', page_id) ELSE concat('/x', page_id) END) END AS request_url
  FROM (SELECT page_id, url, trim({_RAW_HOST}) AS h FROM pages)""",
)(
    lambda spark, sf: t.read(spark, sf, "pages").select(
        "page_id", request_url(F.expr(_RAW_TARGET), F.expr(_RAW_HOST)).alias("request_url")
    )
)


def _event_requests(spark, sf):
    return t.read(spark, sf, "events").select(
        F.lit("events").alias("source"),
        F.col("event_id").alias("req_ord"),
        F.lit("GET").alias("method"),
        F.expr("IF(event_type = 'error', ' ', concat('https://h.test/', event_type, '/', user_id % 7))").alias("url"),
        F.expr("map('X-K', IF(user_id % 2 = 0, array('a', 'b'), array('b', 'a')), 'A', array(CAST(user_id % 3 AS STRING)))").alias("headers"),
        F.col("props").cast("binary").alias("body"),
        F.lit(None).cast("string").alias("error"),
    )


check(
    "request_dedup",
    "SELECT min(event_id) AS req_ord, concat('https://h.test/', event_type, '/', user_id % 7) AS url, arg_min(props, event_id) AS body FROM events WHERE event_type <> 'error' GROUP BY event_type, user_id % 7, user_id % 3",
)(lambda spark, sf: dedup_requests(_event_requests(spark, sf)).select("req_ord", "url", F.col("body").cast("string").alias("body")))
check(
    "request_inherit",
    """SELECT conv_id, turn, concat_ws(';', CASE WHEN role <> '' THEN concat('Accept=', role) END, concat('Cookie=', conv_id)) AS headers FROM conversations""",
)(
    lambda spark, sf: t.read(spark, sf, "conversations")
    .select("conv_id", "turn", F.expr("map('Cookie', array(CAST(conv_id AS STRING), text), 'Accept', array(role), 'Host', array(text), 'User-Agent', array(''))").alias("h"))
    .select("conv_id", "turn", inherited_headers(F.col("h")).alias("h"))
    .select(
        "conv_id", "turn", F.array_join(F.array_sort(F.transform(F.map_entries("h"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), ";").alias("headers")
    )
)

# -- crawl -------------------------------------------------------------------

SCOPE = "*.*.example.com/*"


def _all_pages(spark, sf, captures):
    requests = url_requests(captures.select(ID, "url"), "url", ID)
    return build_frontier(requests, SCOPE)


def _start(captures):
    first = captures.agg(F.min_by("url", ID).alias("url")).withColumn("req_ord", F.lit(1))
    return url_requests(first)


_NAV_SQL = f"""{t.LINKED_SQL}, nav AS (SELECT page_id, url, unnest(list_concat([concat({ORIGIN}, {t.escaped_path(clean_sql('h'))}) FOR h IN regexp_extract_all(html, '{HREF}', 1)], [first_url, second_url])) AS child,
  unnest(generate_series(0, len(regexp_extract_all(html, '{HREF}', 1)) + 1)) AS pos FROM linked)"""
_NEW_SQL = f"""{_NAV_SQL}, fresh AS (SELECT child AS url, min((page_id, pos)) AS place, arg_min(url, page_id) AS discovered_from FROM nav
  WHERE regexp_matches(child, '^https?://[^/.]+[.][^/.]+[.]example[.]com(/|$)') AND child NOT IN (SELECT url FROM pages) GROUP BY child)"""


@check(
    "crawl_closure",
    f"WITH {_NEW_SQL} SELECT url, 0 AS depth, '' AS discovered_from FROM pages UNION ALL SELECT url, 1, discovered_from FROM fresh",
)
def _closure(spark, sf):
    captures = t.linked_pages(spark, sf)
    return crawl(captures, _all_pages(spark, sf, captures)).queue.select("url", "depth", "discovered_from")


@check(
    "crawl_cap",
    f"""WITH {_NEW_SQL}, n AS (SELECT count(*) AS n FROM pages)
  SELECT url, CAST(n + row_number() OVER (ORDER BY place) AS BIGINT) AS queue_ord FROM fresh CROSS JOIN n QUALIFY row_number() OVER (ORDER BY place) <= 60""",
)
def _cap(spark, sf):
    captures = t.linked_pages(spark, sf)
    total = captures.count()
    queue = crawl(captures, _all_pages(spark, sf, captures), max_crawl=total + 60).queue
    return queue.where("depth > 0").select("url", "queue_ord")


@check(
    "crawl_offdomain",
    f"""WITH RECURSIVE {_NAV_SQL}, kids AS (SELECT DISTINCT split_part(url, '#', 1) AS page, child FROM nav),
  r(url, depth) AS (SELECT arg_min(url, page_id), 0 FROM pages UNION SELECT k.child, r.depth + 1 FROM r JOIN kids k ON k.page = split_part(r.url, '#', 1) WHERE r.depth < 20)
  SELECT url, CAST(min(depth) AS INT) AS depth FROM r GROUP BY url""",
)
def _offdomain(spark, sf):
    captures = t.linked_pages(spark, sf)
    found = crawl(captures, build_frontier(_start(captures), SCOPE), allow_off_domain=True)
    return found.queue.select("url", "depth")


# One seed, links by page number: waves go on until no page is new.


def _steps(spark, sf):
    """Pages of one host that link to pages 2n + 1 and 2n + 2: a tree whose queue order is its numbering."""
    pages = t.read(spark, sf, "pages").select("page_id")
    at = lambda n: F.concat(F.lit("https://tree.example.org/p/"), n.cast("string"))
    link = lambda n: F.concat(F.lit('<a href="'), at(n), F.lit('">n</a>'))
    n = F.col("page_id")
    return pages.select(n.alias(ID), F.lit("GET").alias("method"), at(n).alias("url"), at(n).alias("final_url"), at(n).alias("target_url"), F.lit("").alias("parent_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.concat(link(2 * n + 1), link(2 * n + 2), link(F.floor(n / 2))).cast("binary").alias("body"))


def _tree(spark, sf, cap):
    captures = _steps(spark, sf)
    seed = spark.range(1).select(F.lit(1).alias("req_ord"), F.lit("https://tree.example.org/p/0").alias("url"))
    return crawl(captures, build_frontier(url_requests(seed), "https://tree.example.org/*"), max_crawl=cap(captures) if cap else None).queue.select("url", "queue_ord", "depth", "discovered_from")


_TREE_SQL = """WITH n AS (SELECT max(page_id) AS last FROM pages), q AS (SELECT unnest(generate_series(0, 2 * last + 2)) AS i FROM n)
  SELECT concat('https://tree.example.org/p/', i) AS url, CAST(i + 1 AS BIGINT) AS queue_ord, CAST(floor(log2(i + 1)) AS INT) AS depth,
    CASE WHEN i = 0 THEN '' ELSE concat('https://tree.example.org/p/', (i - 1) // 2) END AS discovered_from FROM q"""
check("crawl_waves", _TREE_SQL)(lambda spark, sf: _tree(spark, sf, None))
check("crawl_waves_cap", _TREE_SQL + " WHERE i < (SELECT last // 2 FROM n)")(lambda spark, sf: _tree(spark, sf, lambda captures: captures.agg(F.max(ID)).first()[0] // 2))

_ASKED = "CASE CAST(page_id % 4 AS INT) WHEN 0 THEN concat(split_part(url, '#', 1), '#part') WHEN 1 THEN replace(url, 'example', 'nowhere') ELSE url END"


def _asked(spark, sf):
    captures = t.pages(spark, sf)
    asked = t.read(spark, sf, "pages").select("page_id", F.expr(_ASKED).alias("url"))
    return crawl(captures, build_frontier(url_requests(asked, "url", "page_id"), "example.com"))


_ASKED_SQL = f"asked AS (SELECT page_id, {_ASKED} AS url FROM pages), firsts AS (SELECT DISTINCT url FROM asked)"
check(
    "crawl_fetch",
    f"""WITH {_ASKED_SQL}, {t.pages_sql()} SELECT a.url, a.url AS final_url, s.status, md5(s.body) AS body, 'example.com' AS target_url
  FROM firsts a JOIN (SELECT * FROM site QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY capture_id DESC) = 1) s
    ON split_part(s.url, '#', 1) = split_part(a.url, '#', 1)""",
)(lambda spark, sf: _asked(spark, sf).resources.select("url", "final_url", "status", F.md5("body").alias("body"), "target_url"))
check(
    "crawl_missing",
    f"WITH {_ASKED_SQL} SELECT url FROM firsts WHERE split_part(url, '#', 1) NOT IN (SELECT split_part(url, '#', 1) FROM pages)",
)(lambda spark, sf: _asked(spark, sf).unreachable.select("url"))

# -- save paths --------------------------------------------------------------

check("save_path", f"WITH {t.pages_sql()} SELECT capture_id, {t.PATH_SQL} AS relative_path FROM site")(
    lambda spark, sf: with_relative_path(t.pages(spark, sf)).select(ID, "relative_path")
)
check(
    "save_manifest",
    f"""WITH {t.pages_sql()} SELECT capture_id + CAST(3000000000 AS BIGINT) AS ord, concat_ws(chr(9), CAST(capture_id + 3000000000 AS VARCHAR), CAST(status AS VARCHAR), content_type, url, {t.PATH_SQL}) AS value FROM site""",
)(lambda spark, sf: manifest_lines(manifest(t.pages(spark, sf).withColumn(ID, F.col(ID) + 3_000_000_000), ID)))
check(
    "save_scope",
    f"SELECT page_id AS capture_id, url FROM pages WHERE page_id % 2 = 1 AND regexp_matches(url, '^https?://[^/]+/en/')",
)(
    lambda spark, sf: rows_to_save(
        t.pages(spark, sf).withColumn("target_url", F.expr(f"concat('*.', IF(page_id % 2 = 0, 'x.', ''), {DOMAIN}, '/en/*')".replace("page_id", ID)))
    ).select(ID, "url")
)
