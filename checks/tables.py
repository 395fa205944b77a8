"""Captures derived from the given tables, in Spark and in SQL.

Bodies, content types and links are functions of each row, so every check runs
over the whole table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievenet.session import spread

TYPES = (
    "text/html",
    "text/html; charset=utf-8",
    " application/javascript ;v=1",
    "application/json",
    "text/xml",
    "text/css",
    "application/octet-stream",
)

# SQL text shared by Spark and DuckDB: both evaluate it to the same string.
SITE_BODY = r"""concat(url, chr(10), html, chr(10),
  'GET ', url, '.json?v=', page_id, chr(10),
  '{"paths": {"/pages/', page_id, '": {"get": {}}, "/x/', md5(url), '" : {}}}', chr(10),
  'spec /docs/', page_id, '/swagger-v1.json and https://h.test/openapi/', page_id, '.json?full', chr(10),
  'query https://h.test/graphql?id=', page_id, ' or /v2/gql/', page_id, chr(10),
  'call /api/items/', page_id, '?a=1&b=2 then /api/items/', page_id, '?a=1&b=2', chr(10),
  'jwt eyJ', md5(url), '.', md5(html), '.', md5(concat(url, html)), chr(10),
  'mail Page.', page_id, '+x@mail-', page_id, '.example.org, next', chr(10),
  'API_KEY = "', md5(html), '"; Token:', md5(url), chr(10))"""

LINK_BODY = r"""concat(html, '<script src="/assets/app-', page_id, '.js?v=1&amp;w=2"></script>',
  '<link rel=x href="/data/', page_id, '.json"><a href=''img/p', page_id, '.png''>i</a>', chr(10),
  '<script>var api = "/api/items/', page_id, '"; url: ''./rel/', page_id, '.map'';', chr(10),
  'fetch("https://cdn.test/lib/', page_id, '.xml?x=json"); src = " ";', chr(10),
  '//# sourceMappingURL=maps/', page_id, '.js.map', chr(10), '</script>')"""


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as captures."""
    return spread(read(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("capture_id"),
        F.expr("concat('https://', source, '.example.org/', lang, '/', doc_id, '.txt')").alias("final_url"),
        F.lit("https://example.org").alias("target_url"),
        F.concat(F.lit("https://example.org/"), "source").alias("parent_url"),
        F.lit(200).alias("status"),
        F.lit("text/plain").alias("content_type"),
        F.col("text").cast("binary").alias("body"),
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as captures found from their conversation."""
    return spread(read(spark, sf, "conversations"), "conv_id").select(
        F.col("conv_id").alias("capture_id"),
        F.expr("concat('https://chat.test/', conv_id, '/', turn, '.json')").alias("final_url"),
        F.lit("https://chat.test").alias("target_url"),
        F.expr("concat('https://chat.test/', conv_id)").alias("parent_url"),
        F.lit(200).alias("status"),
        F.col("role").alias("content_type"),
        F.col("text").cast("binary").alias("body"),
    )


def pages(spark: SparkSession, sf: str, body: str = "html") -> DataFrame:
    """Pages as raw captures with a body expression and a type per page."""
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), (F.col("page_id") % len(TYPES) + 1).cast("int"))
    return spread(read(spark, sf, "pages"), "page_id").select(
        F.col("page_id").alias("capture_id"),
        F.lit("GET").alias("method"),
        "url",
        F.col("url").alias("final_url"),
        F.col("url").alias("target_url"),
        F.lit("").alias("parent_url"),
        F.expr("CAST(200 + page_id % 5 AS INT)").alias("status"),
        kind.alias("content_type"),
        F.expr(body).cast("binary").alias("body"),
    )


def html_pages(spark: SparkSession, sf: str, body: str = LINK_BODY) -> DataFrame:
    return pages(spark, sf, body).withColumn("content_type", F.lit("text/html"))


def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """HTML pages that also link to two other pages, forming a graph."""
    table = read(spark, sf, "pages").select("page_id", "url", "html")
    total = table.count()
    ids = table.select("page_id", "url")
    base = spread(table, "page_id")
    first = ids.select(F.col("page_id").alias("_one"), F.col("url").alias("first_url"))
    second = ids.select(F.col("page_id").alias("_two"), F.col("url").alias("second_url"))
    return (
        base.withColumn("_one", (F.col("page_id") * 2 + 1) % total)
        .withColumn("_two", (F.col("page_id") * 2 + 2) % total)
        .join(first, "_one")
        .join(second, "_two")
        .select(
            F.col("page_id").alias("capture_id"),
            F.lit("GET").alias("method"),
            "url",
            F.col("url").alias("final_url"),
            F.col("url").alias("target_url"),
            F.lit("").alias("parent_url"),
            F.lit(200).alias("status"),
            F.lit("text/html").alias("content_type"),
            F.expr(
                "concat(html, '<a href=\"', first_url, '\">1</a>', '<a href=\"', second_url, '\">2</a>')"
            )
            .cast("binary")
            .alias("body"),
        )
    )


# -- the same in SQL ---------------------------------------------------------

SQL_TYPES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
SQL_TYPE = f"{SQL_TYPES}[CAST(page_id % {len(TYPES)} AS INT) + 1]"

DOCUMENTS_SQL = """docs AS (SELECT doc_id AS capture_id, text AS body,
  concat('https://', source, '.example.org/', lang, '/', doc_id, '.txt') AS final_url,
  'https://example.org' AS target_url, concat('https://example.org/', source) AS parent_url,
  200 AS status, 'text/plain' AS content_type FROM documents)"""

CONVERSATIONS_SQL = """turns AS (SELECT conv_id AS capture_id, text AS body,
  concat('https://chat.test/', conv_id, '/', turn, '.json') AS final_url,
  'https://chat.test' AS target_url, concat('https://chat.test/', conv_id) AS parent_url,
  200 AS status, role AS content_type FROM conversations)"""


def pages_sql(body: str = "html", name: str = "site") -> str:
    return f"""{name} AS (SELECT page_id AS capture_id, page_id, url, url AS final_url, url AS target_url, '' AS parent_url,
  CAST(200 + page_id % 5 AS INT) AS status, {SQL_TYPE} AS content_type, {body} AS body FROM pages)"""


# A URL without its fragment answers with its latest capture.
LINKED_SQL = """linked AS (
  SELECT p.page_id, p.url, q.html, a.url AS first_url, b.url AS second_url
  FROM (SELECT *, max(page_id) OVER (PARTITION BY split_part(url, '#', 1)) AS latest FROM pages) p
  JOIN pages q ON q.page_id = p.latest CROSS JOIN (SELECT count(*) AS n FROM pages) t
  JOIN pages a ON a.page_id = (2 * q.page_id + 1) % t.n
  JOIN pages b ON b.page_id = (2 * q.page_id + 2) % t.n)"""


def lines_sql(source: str, name: str = "lines") -> str:
    return f"""{name} AS (SELECT *, unnest(string_split(body, chr(10))) AS text,
  CAST(unnest(generate_series(1, len(string_split(body, chr(10))))) AS INT) AS line FROM {source})"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def escaped_path(expression: str) -> str:
    """Percent-encoding of a path with characters that need it, in SQL."""
    text = f"url_encode({expression})"
    for char in "$&+,/:;=@":
        text = f"replace({text}, '%{ord(char):02X}', '{char}')"
    legal = "^(?:[A-Za-z0-9_.~$&+,/:;=@!''()*\\[\\]-]|%[0-9A-Fa-f]{2})*$"
    return f"CASE WHEN regexp_matches({expression}, '{legal}') THEN {expression} ELSE {text} END"


# The path a page is saved under.
_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
_FILE = "regexp_extract(url, '^https?://[^/]+/[^/]+/([^/?#]*)', 1)"
_QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"
_BY_TYPE = """CASE WHEN content_type LIKE '%html%' THEN '.html' WHEN content_type LIKE '%javascript%' THEN '.js' WHEN content_type LIKE '%json%' THEN '.json'
  WHEN content_type LIKE '%xml%' THEN '.xml' WHEN content_type LIKE '%css%' THEN '.css' ELSE '.bin' END"""
PATH_SQL = f"""concat({_HOST}, '/', regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1), '/', regexp_replace({_FILE}, '[.]html$', ''),
  CASE WHEN {_QUERY} <> '' THEN concat('__', substr(sha1({_QUERY}), 1, 8)) ELSE '' END, CASE WHEN {_FILE} LIKE '%.html' THEN '.html' ELSE {_BY_TYPE} END)"""
