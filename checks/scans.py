"""Checks of patterns, scans, kinds, sinks and replays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import tables as t
from sievenet.functions import text as T
from sievenet.operators.scan import lines, scan, top_findings
from sievenet.session import new_dir, spread
from sievenet.sinks.corpus import read_corpus, write_corpus
from sievenet.sinks.findings import CSV_OPTIONS, output_kind, stream_findings, write_findings, write_report
from sievenet.sources.captures import normalize_captures
from sievenet.sources.patterns import assemble, find_by_names, load_patterns, packaged_patterns, parse_catalog, select_patterns
from sievenet.sources.saved import find_scan_dirs, read_saved_scans, resolve_saved_scans

QUERIES, ORACLES = {}, {}
CUSTOM = ("[Tt]h[a-z]+", "[0-9]{4}")
BUILTIN_KEYS = {
    "scan_jwt": "JWT",
    "scan_email": "email",
    "scan_url": "URL",
    "scan_api_path": "internal API path",
    "scan_json_endpoint": "JSON endpoint",
    "scan_openapi_spec": "Swagger/OpenAPI spec",
    "scan_openapi_path": "Swagger/OpenAPI path",
    "scan_graphql": "GraphQL endpoint",
    "scan_api_key": "API key-like string",
}
ID = "capture_id"


def check(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def matches_sql(patterns, source: str = "lines", dedup: bool = True, columns: str = "*") -> str:
    """Findings of a pattern list over ``lines`` (list order is pattern order)."""
    parts, seen = [], set()
    for ordinal, p in enumerate(patterns):
        if dedup and p.regex in seen:
            continue
        seen.add(p.regex)
        found = f"regexp_extract_all(text, {t.quoted(p.regex)})"
        if dedup:
            found = f"list_distinct({found})"
        parts.append(
            f"SELECT *, {t.quoted(p.regex)} AS pattern, {t.quoted(p.name)} AS pattern_name, "
            f"{t.quoted(p.source)} AS pattern_source, {ordinal} AS pattern_ord, unnest({found}) AS matched_value FROM {source}"
        )
    return f"SELECT {columns} FROM (" + " UNION ALL ".join(parts) + ")"


KIND_SQL = """CASE WHEN lower(content_type) LIKE '%html%' THEN 'html'
  WHEN lower(content_type) LIKE '%javascript%' OR lower(content_type) LIKE '%ecmascript%' THEN 'js'
  WHEN lower(content_type) LIKE '%json%' THEN 'json' WHEN lower(content_type) LIKE '%xml%' THEN 'xml'
  WHEN lower(content_type) LIKE '%css%' THEN 'css' WHEN lower(content_type) LIKE '%text%' THEN 'text'
  WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext IN ('.js', '.mjs') THEN 'js' WHEN ext = '.json' THEN 'json'
  WHEN ext = '.xml' THEN 'xml' WHEN ext = '.css' THEN 'css' WHEN ext = '.map' THEN 'map' WHEN ext = '.txt' THEN 'text'
  ELSE 'unknown' END"""


def ext_sql(expression: str) -> str:
    return f"lower(regexp_extract({expression}, '(\\.[^./]*)$', 1))"


# -- scans -------------------------------------------------------------------

check("scan_lines", f"WITH {t.DOCUMENTS_SQL}, {t.lines_sql('docs')} SELECT capture_id, line, text FROM lines")(
    lambda spark, sf: lines(t.documents(spark, sf), keep=[ID])
)


def _builtin(key: str, name: str) -> None:
    chosen = find_by_names(packaged_patterns(), [name])
    fields = ["pattern_name", "matched_value", "line"]
    sql = f"WITH {t.pages_sql(t.SITE_BODY)}, {t.lines_sql('site')} " + matches_sql(
        chosen, columns="capture_id, pattern_name, matched_value, line"
    )
    check(key, sql)(lambda spark, sf: scan(t.pages(spark, sf, t.SITE_BODY), chosen, fields=fields, keep=[ID]))


for _key, _name in BUILTIN_KEYS.items():
    _builtin(_key, _name)

_ALL = assemble(packaged_patterns(), CUSTOM)
_COLUMNS = "capture_id, pattern, pattern_name, pattern_source, matched_value, line"
_FIELDS = ["pattern", "pattern_name", "pattern_source", "matched_value", "line"]
check("scan_multi", f"WITH {t.DOCUMENTS_SQL}, {t.lines_sql('docs')} " + matches_sql(_ALL, columns=_COLUMNS))(
    lambda spark, sf: scan(t.documents(spark, sf), _ALL, fields=_FIELDS, keep=[ID])
)

_TWICE = assemble(custom=["(?:th|Th|de|la)[a-zé]*", "[a-z]+ing"])
for _key, _dedup in (("scan_dedup", True), ("scan_nodedup", False)):
    check(
        _key,
        f"WITH {t.CONVERSATIONS_SQL}, {t.lines_sql('turns')} "
        + matches_sql(_TWICE, dedup=_dedup, columns="pattern, matched_value, line, final_url AS resource_url, parent_url AS discovered_from, target_url, content_type, status"),
    )(
        lambda spark, sf, dedup=_dedup: scan(
            t.conversations(spark, sf),
            _TWICE,
            dedup=dedup,
            fields=["pattern", "matched_value", "line", "resource_url", "discovered_from", "target_url", "content_type", "status"],
        )
    )

_LOOPS = assemble(custom=["(?:[a-z]|-)+ing", "(?:the|an|in)+s", "(?:[a-z]+, ?)+"])
check(
    "scan_long_lines",
    f"WITH {t.DOCUMENTS_SQL}, whole AS (SELECT capture_id, replace(body, chr(10), ' ') AS text FROM docs) " + matches_sql(_LOOPS, source="whole", columns="capture_id, pattern, matched_value"),
)(
    lambda spark, sf: scan(
        t.documents(spark, sf).withColumn("body", F.expr("CAST(replace(CAST(body AS STRING), chr(10), ' ') AS BINARY)")), _LOOPS, fields=["pattern", "matched_value"], keep=[ID]
    )
)

# Loops whose repeats begin alike, overlap what follows, or may be empty.
_AMBIGUOUS = assemble(
    custom=[
        r"(?:[a-z0-9-]+\.)+[a-z]{2,}",
        r"https?://(?:[\w-]+\.)+\w+",
        r"(?:\w+\.)*\w+@\w+",
        r"(\w+,)+x",
        "(?:[^,]+,)+end",
        "(e|en)*t",
        r"(?:[0-9]+\.)+[0-9]+",
        r"(\w+\s?)+$",
        "(?:[A-Z][a-z]+ )+[A-Z]",
        "([a-z]+[0-9]*)+@",
        "t(?:h*|eh*)*",
        r"\b(?:[a-z]+ ){2,}the\b",
        "(?:an|a|n)+?d",
    ]
)
check("scan_ambiguous_loops", f"WITH {t.DOCUMENTS_SQL}, {t.lines_sql('docs')} " + matches_sql(_AMBIGUOUS, columns="capture_id, line, pattern, matched_value"))(
    lambda spark, sf: scan(t.documents(spark, sf), _AMBIGUOUS, fields=["line", "pattern", "matched_value"], keep=[ID])
)

# Byte windows are cut on the hex form; broken characters at a cut are counted.
_CONTEXT_PATTERNS = assemble(custom=["[Tt]h[a-z]+", "é[a-zé]+"])
_CONTEXT_SQL = (
    f"WITH {t.DOCUMENTS_SQL}, {t.lines_sql('docs')}, hits AS ("
    + matches_sql(_CONTEXT_PATTERNS)
    + r"""), offs AS (SELECT *, strlen(split_part(text, matched_value, 1)) AS o, strlen(text) AS n, strlen(matched_value) AS m FROM hits),
  cuts AS (SELECT *, greatest(o - 80, 0) AS s, least(o + m + 80, n) AS e FROM offs),
  hexed AS (SELECT *, substr(hex(encode(text)), CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)) AS h FROM cuts),
  parts AS (SELECT *, '^((?:[89AB].){0,3})((?:[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)*)(.*)$' AS re FROM hexed)
  SELECT capture_id, line, matched_value, concat(CASE WHEN s > 0 THEN '...' ELSE '' END,
    trim(concat(repeat('�', CAST(length(regexp_extract(h, re, 1)) // 2 AS BIGINT)), decode(unhex(regexp_extract(h, re, 2))),
      CASE WHEN regexp_extract(h, re, 3) <> '' THEN '�' ELSE '' END)),
    CASE WHEN e < n THEN '...' ELSE '' END) AS context FROM parts"""
)
check("scan_context", _CONTEXT_SQL)(
    lambda spark, sf: scan(
        t.documents(spark, sf), _CONTEXT_PATTERNS, fields=["line", "matched_value", "context"], keep=[ID]
    )
)

check(
    "scan_fields",
    f"WITH {t.pages_sql(t.SITE_BODY)}, {t.lines_sql('site')} "
    + matches_sql(packaged_patterns(), columns="pattern, pattern_name, final_url AS resource_url, matched_value"),
)(lambda spark, sf: scan(t.pages(spark, sf, t.SITE_BODY), packaged_patterns()))

check(
    "scan_topk",
    f"WITH {t.DOCUMENTS_SQL}, {t.lines_sql('docs')} SELECT resource_url, line, matched_value, pattern_ord FROM ("
    + matches_sql(_ALL, columns="final_url AS resource_url, line, matched_value, CAST(pattern_ord AS INT) AS pattern_ord")
    + ") ORDER BY resource_url, line, matched_value, pattern_ord LIMIT 500",
)(
    lambda spark, sf: top_findings(
        scan(t.documents(spark, sf), _ALL, fields=["resource_url", "line", "matched_value"], keep=["pattern_ord", "match_ord"]),
        500,
    ).drop("match_ord")
)

check(
    "pattern_alias",
    f"WITH {t.pages_sql(t.SITE_BODY)}, {t.lines_sql('site')} "
    + matches_sql(
        assemble(find_by_names(packaged_patterns(), ["email", "JWT"]), ["mail"], builtin_alias_custom=True),
        dedup=False,
        columns="capture_id, pattern_name, pattern_source, matched_value",
    ),
)(
    lambda spark, sf: scan(
        t.pages(spark, sf, t.SITE_BODY),
        assemble(find_by_names(packaged_patterns(), ["email", "JWT"]), ["mail"], builtin_alias_custom=True),
        dedup=False,
        fields=["pattern_name", "pattern_source", "matched_value"],
        keep=[ID],
    )
)

# A catalog table: every part names a pattern; some lines are comments or blank.
_CATALOG_LINE = """CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN concat('# ', p_name) WHEN 1 THEN ''
  ELSE concat('  ', p_brand, ' || ', p_type, '|', p_partkey, '  ') END"""
_CATALOG_SQL = f"""WITH l AS (SELECT p_brand AS file, p_partkey AS line_no,
    trim(CASE WHEN p_size = 7 AND p_brand < 'Brand#2' THEN concat(p_name, '|', p_type) ELSE {_CATALOG_LINE} END) AS v FROM part),
  r AS (SELECT file, line_no, trim(CASE WHEN v LIKE '%||%' THEN split_part(v, '||', 1) ELSE '' END) AS name,
    trim(CASE WHEN v LIKE '%||%' THEN substr(v, strpos(v, '||') + 2) ELSE '' END) AS regex FROM l WHERE v <> '' AND NOT starts_with(v, '#'))
  SELECT file, line_no, name, regex, NOT bool_or(name = '' OR regex = '') OVER (PARTITION BY file) AS valid FROM r"""


def _catalog(spark, sf):
    text = f"CASE WHEN p_size = 7 AND p_brand < 'Brand#2' THEN concat(p_name, '|', p_type) ELSE {_CATALOG_LINE} END"
    part = t.read(spark, sf, "part")
    return parse_catalog(part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line_no"), F.expr(text).alias("value")))


check("pattern_catalog", _CATALOG_SQL)(_catalog)
check(
    "pattern_select",
    f"WITH c AS ({_CATALOG_SQL}), last AS (SELECT name, arg_max(regex, line_no) AS regex FROM c WHERE valid GROUP BY name) "
    "SELECT s.s_suppkey AS asked, last.name, last.regex FROM supplier s JOIN last ON last.name = concat('Brand#', 1 + s.s_suppkey % 7, 1 + s.s_suppkey % 5)",
)(
    lambda spark, sf: select_patterns(
        _catalog(spark, sf).where("valid"),
        t.read(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("asked"), F.expr("concat('Brand#', 1 + s_suppkey % 7, 1 + s_suppkey % 5)").alias("name")
        ),
    ).select("asked", "name", "regex")
)

# -- kinds and types ---------------------------------------------------------

_PATHS = "concat(regexp_replace(url, '[?#].*$', ''), ['', '.html', '.JS', '.mjs', '.json', '.xml', '.css', '.txt', '.php', '.', '.map', '.htm'][CAST(page_id % 12 AS INT) + 1])"
_SPARK_PATHS = "concat(regexp_replace(url, '[?#].*$', ''), array('', '.html', '.JS', '.mjs', '.json', '.xml', '.css', '.txt', '.php', '.', '.map', '.htm')[CAST(page_id % 12 AS INT)])"


def _paths(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", F.expr(_SPARK_PATHS).alias("path"))


check("url_ext", f"SELECT page_id, {ext_sql('path')} AS ext FROM (SELECT page_id, {_PATHS} AS path FROM pages)")(
    lambda spark, sf: _paths(spark, sf).select("page_id", T.extension(F.col("path")).alias("ext"))
)
check(
    "content_type_from_path",
    f"""WITH p AS (SELECT page_id, {_PATHS} AS path FROM pages), e AS (SELECT page_id, {ext_sql('path')} AS ext FROM p)
  SELECT page_id, CASE WHEN ext IN ('.html', '.htm', '.', '.php') THEN 'text/html' WHEN ext IN ('.js', '.mjs') THEN 'application/javascript'
    WHEN ext = '.json' THEN 'application/json' WHEN ext = '.xml' THEN 'application/xml' WHEN ext = '.css' THEN 'text/css'
    WHEN ext = '.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS content_type FROM e""",
)(lambda spark, sf: _paths(spark, sf).select("page_id", T.content_type_from_path(F.col("path")).alias("content_type")))
check(
    "resource_kind",
    f"""WITH s AS (SELECT page_id, {t.SQL_TYPE} AS content_type, {ext_sql('p')} AS ext FROM (SELECT *, {_PATHS} AS p FROM pages))
  SELECT page_id, {KIND_SQL} AS resource_kind FROM s""",
)(
    lambda spark, sf: t.pages(spark, sf)
    .join(_paths(spark, sf).withColumnRenamed("page_id", ID), ID)
    .select(F.col(ID).alias("page_id"), T.resource_kind(F.col("content_type"), F.col("path")).alias("resource_kind"))
)


def _packed(spark, sf):
    """Pages as they are served: a third gzip, a third deflate, packed by Spark's workers."""

    def pack(body, i):
        import gzip
        import zlib

        return (bytes, gzip.compress, zlib.compress)[i % 3](bytes(body))

    packed = F.udf(pack, "binary", useArrow=False)("body", ID)
    kinds = F.element_at(F.array(F.lit(" Identity "), F.lit("GZIP"), F.lit(" deflate")), (F.col(ID) % 3 + 1).cast("int"))
    return t.pages(spark, sf).withColumns({"content_encoding": kinds, "body": packed})


check(
    "capture_normalize",
    f"""WITH {t.pages_sql()} SELECT capture_id, 'GET' AS method, url, final_url, status, trim(split_part(content_type, ';', 1)) AS content_type,
  CAST(strlen(body) AS INT) AS bytes, md5(body) AS body FROM site""",
)(lambda spark, sf: normalize_captures(_packed(spark, sf)).select(ID, "method", "url", "final_url", "status", "content_type", F.octet_length("body").alias("bytes"), F.md5("body").alias("body")))
check(
    "capture_truncated",
    f"WITH {t.pages_sql()} SELECT capture_id, strlen(body) > 3000 AS truncated, CAST(least(strlen(body), 3000) AS INT) AS bytes FROM site",
)(lambda spark, sf: normalize_captures(_packed(spark, sf), max_body=3000).select(ID, "truncated", F.octet_length("body").alias("bytes")))

# -- sinks -------------------------------------------------------------------

_SINK_FIELDS = ["line", "matched_value", "resource_url", "status"]


def _sink_findings(spark, sf):
    return scan(t.pages(spark, sf, t.SITE_BODY), find_by_names(packaged_patterns(), ["Swagger/OpenAPI path", "URL"]), fields=_SINK_FIELDS)


_SINK_SQL = f"WITH {t.pages_sql(t.SITE_BODY)}, {t.lines_sql('site')}, f AS (" + matches_sql(
    find_by_names(packaged_patterns(), ["Swagger/OpenAPI path", "URL"]), columns="line, matched_value, final_url AS resource_url, status"
) + ") "


def _written(kind):
    def run(spark, sf):
        path = new_dir(spark, f"sink-{kind}")
        write_findings(_sink_findings(spark, sf), path, kind)
        if kind == "csv":
            schema = ", ".join(f"{name} string" for name in _SINK_FIELDS)
            return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)
        return spark.read.text(path)

    return run


check("sink_plain", _SINK_SQL + "SELECT concat_ws(chr(9), line, matched_value, resource_url, status) AS value FROM f")(_written("plain"))
check(
    "sink_csv",
    _SINK_SQL + "SELECT CAST(line AS VARCHAR) AS line, matched_value, resource_url, CAST(status AS VARCHAR) AS status FROM f",
)(_written("csv"))
check(
    "sink_json",
    _SINK_SQL
    + r"""SELECT replace(concat('{"line":"', line, '","matched_value":"', replace(matched_value, '"', '\"'), '","resource_url":"', resource_url,
  '","status":"', status, '"}'), '&', '\u0026') AS value FROM f""",
)(_written("json"))



def _report(spark, sf):
    """The lines of a written report, numbered part after part as they are read back."""
    path = new_dir(spark, "report")
    found = scan(t.documents(spark, sf), _ALL, fields=["resource_url", "line", "matched_value"], keep=["pattern_ord", "match_ord"])
    write_report(found, path, "plain")
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("part"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return rows.withColumn("place", place).join(before, "part").select((F.col("before") + F.col("place")).cast("bigint").alias("place"), "value")


check(
    "report_order",
    f"WITH {t.DOCUMENTS_SQL}, {t.lines_sql('docs')}, f AS ("
    + matches_sql(_ALL, columns="final_url AS resource_url, line, matched_value, pattern_ord")
    + ") SELECT row_number() OVER (ORDER BY resource_url, line, matched_value, pattern_ord) AS place, concat_ws(chr(9), resource_url, line, matched_value) AS value FROM f",
)(_report)

_OUTPUTS = "concat(['', ' ', 'out/', 'a.b/c/'][CAST(page_id % 4 AS INT) + 1], ['json', 'plain', 'csv', 'parquet', 'x.JSON', 'y.Csv', 'z.txt', url, 'JSON', 'w.json '][CAST(page_id % 10 AS INT) + 1])"
check(
    "output_kind",
    f"""WITH o AS (SELECT page_id, {_OUTPUTS} AS output FROM pages)
  SELECT page_id, output, CASE WHEN trim(output) IN ('plain', 'json', 'csv', 'parquet') THEN trim(output)
    WHEN regexp_matches(lower(trim(output)), '[.](json|csv)$') THEN regexp_extract(lower(trim(output)), '[.]([a-z]*)$', 1) ELSE 'plain' END AS kind FROM o""",
)(
    lambda spark, sf: t.read(spark, sf, "pages")
    .select("page_id", F.expr("concat(elt(CAST(page_id % 4 AS INT) + 1, '', ' ', 'out/', 'a.b/c/'), elt(CAST(page_id % 10 AS INT) + 1, 'json', 'plain', 'csv', 'parquet', 'x.JSON', 'y.Csv', 'z.txt', url, 'JSON', 'w.json '))").alias("output"))
    .withColumn("kind", output_kind(F.col("output")))
)


def _precedence(spark, sf):
    """Of a missing, a broken and two good pattern files only the first good one counts."""
    root = new_dir(spark, "patterns")
    brands = t.read(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand")
    line = lambda text: brands.select(F.expr(text).alias("value")).coalesce(1)
    line("p_brand").write.text(f"{root}/broken")
    line("concat(p_brand, ' || ', lower(p_brand), '[0-9]* || x')").write.text(f"{root}/first")
    line("concat('never || ', p_brand)").write.text(f"{root}/second")
    found = load_patterns(spark, ["", f"{root}/none", f"{root}/broken", f"{root}/first", f"{root}/second"])
    rows = [(p.name, p.regex, p.source.replace(root, "")) for p in found]
    return spark.createDataFrame(rows, "name string, regex string, source string")


check(
    "pattern_precedence",
    "SELECT DISTINCT p_brand AS name, concat(lower(p_brand), '[0-9]* || x') AS regex, concat('builtin:/first:', p_brand) AS source FROM part",
)(_precedence)

# -- saved scans -------------------------------------------------------------

_HOST = "regexp_extract(url, '//([^/]+)', 1)"


def _saved(spark, sf):
    """Each host's pages as a saved scan; some manifests are broken."""
    rows = t.pages(spark, sf, t.SITE_BODY).withColumn("scan_dir", F.expr(_HOST))
    listed = rows.select("scan_dir", ID, "status", F.col("url"), F.expr("concat('p/', capture_id, '.html')").alias("relative_path"), "body")
    hosts = listed.groupBy("scan_dir").agg(F.min(ID).alias("first"))
    row = "concat_ws(chr(9), lpad(capture_id, 6, '0'), IF(first % 3 = 1, 'x', CAST(status AS STRING)), 'text/html', url, relative_path)"
    lines_ = listed.join(hosts, "scan_dir").where("first % 3 <> 2").select("scan_dir", F.col(ID).alias("line_no"), F.expr(row).alias("value"))
    index = hosts.where("first % 3 <> 2").select("scan_dir", F.lit("index.txt").alias("relative_path"), F.lit(b"").alias("body"))
    return resolve_saved_scans(listed.select("scan_dir", "relative_path", "body").unionByName(index), lines_)


_SAVED_SQL = f"""WITH {t.pages_sql(t.SITE_BODY)}, h AS (SELECT *, {_HOST} AS scan_dir FROM site),
  m AS (SELECT *, min(capture_id) OVER (PARTITION BY scan_dir) % 3 = 0 AS ok FROM h),
  saved AS (SELECT scan_dir, CASE WHEN ok THEN capture_id END AS queue_ord, CASE WHEN ok THEN url ELSE concat('file://p/', capture_id, '.html') END AS final_url,
    CASE WHEN ok THEN status ELSE 200 END AS status, 'text/html' AS content_type, body FROM m)"""
check("history_manifest", _SAVED_SQL + " SELECT scan_dir, queue_ord, final_url, status, content_type, md5(body) AS body FROM saved")(
    lambda spark, sf: _saved(spark, sf).select("scan_dir", "queue_ord", "final_url", "status", "content_type", F.md5("body").alias("body"))
)
check(
    "history_scan",
    _SAVED_SQL + f", {t.lines_sql('saved')} " + matches_sql(packaged_patterns(), columns="scan_dir, pattern_name, matched_value, final_url AS resource_url, line, '' AS discovered_from"),
)(
    lambda spark, sf: scan(
        _saved(spark, sf), packaged_patterns(), fields=["pattern_name", "matched_value", "resource_url", "line", "discovered_from"], keep=["scan_dir"]
    )
)

def _saved_below(spark, sf):
    """Page bodies written as files below a root, some hosts with a manifest, and read back as saved scans."""
    root = new_dir(spark, "history")
    rows = t.read(spark, sf, "pages").select("page_id", F.expr(_HOST).alias("host"), F.expr("concat(replace(html, chr(10), ' '), ' ', url)").alias("value"))
    spread(rows.withColumns({"dir": F.expr("concat(host, '__', page_id)")}).select("dir", "value"), "dir").write.partitionBy("dir").text(root)
    found = read_saved_scans(spark, root, discover=True)
    return found.where("scan_dir <> ''").select(F.expr("substring_index(scan_dir, '=', -1)").alias("scan"), "status", "content_type", F.md5("body").alias("body"))


check(
    "history_files",
    f"SELECT concat({_HOST}, '__', page_id) AS scan, 200 AS status, 'text/plain' AS content_type, md5(concat(replace(html, chr(10), ' '), ' ', url, chr(10))) AS body FROM pages",
)(_saved_below)
check(
    "history_multi",
    f"""WITH p AS (SELECT concat({_HOST}, '/', CASE WHEN page_id % 3 = 0 THEN 'index.txt' ELSE concat(page_id % 4, '/', CASE WHEN page_id % 5 = 0 THEN 'index.txt' ELSE 'a.html' END) END) AS path FROM pages)
  SELECT DISTINCT scan_dir FROM (SELECT split_part(path, '/', 1) AS scan_dir FROM p
  UNION ALL SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM p WHERE path LIKE '%/index.txt')""",
)(
    lambda spark, sf: find_scan_dirs(
        t.read(spark, sf, "pages").select(
            F.expr(
                f"concat({_HOST}, '/', IF(page_id % 3 = 0, 'index.txt', concat(page_id % 4, '/', IF(page_id % 5 = 0, 'index.txt', 'a.html'))))"
            ).alias("path")
        )
    )
)


def _roundtrip(spark, sf):
    path = new_dir(spark, "corpus")
    write_corpus(t.pages(spark, sf, t.SITE_BODY), path, mode="full", order=ID)
    return scan(read_corpus(spark, path), packaged_patterns(), fields=["pattern_name", "matched_value", "resource_url", "line"])


# Pages that share a path (a fragment apart) share the body saved last.
check(
    "corpus_roundtrip",
    f"""WITH {t.pages_sql(t.SITE_BODY)}, last AS (SELECT *, max(capture_id) OVER (PARTITION BY {t.PATH_SQL}) AS w FROM site),
  kept AS (SELECT a.url AS final_url, b.body FROM last a JOIN site b ON b.capture_id = a.w), {t.lines_sql('kept')} """
    + matches_sql(packaged_patterns(), columns="pattern_name, matched_value, final_url AS resource_url, line"),
)(_roundtrip)


def _stream(spark, sf):
    schema = t.read(spark, sf, "documents").schema
    # As a pattern, the path stands for a file or a folder of part files; a plain one must be a folder.
    raw = spark.readStream.schema(schema).parquet(f"{sf}/documents.parque[t]")
    captures = normalize_captures(
        raw.select(
            F.expr("concat('https://', source, '.example.org/', lang, '/', doc_id, '.txt')").alias("url"),
            F.lit("text/plain").alias("content_type"),
            F.col("text").cast("binary").alias("body"),
        )
    )
    out = new_dir(spark, "stream")
    findings = scan(captures, _ALL, fields=["pattern_name", "pattern", "matched_value", "resource_url", "line"])
    stream_findings(findings, f"{out}/data", f"{out}/state", "parquet").awaitTermination()
    return spark.read.schema(findings.schema).parquet(f"{out}/data")


check(
    "scan_stream",
    f"WITH {t.DOCUMENTS_SQL}, {t.lines_sql('docs')} " + matches_sql(_ALL, columns="pattern_name, pattern, matched_value, final_url AS resource_url, line"),
)(_stream)
