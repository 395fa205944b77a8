"""Target scopes: parsing targets, matching URLs, seeds and the seed queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievenet.functions import urls
from sievenet.functions.built import built_once
from sievenet.functions.text import trim_space


def _path_regex(pattern: Column) -> Column:
    quoted = F.regexp_replace(pattern, "([\\x{21}-\\x{29}\\x{2b}-\\x{2e}\\x{3a}-\\x{40}\\[-`{-~])", "\\\\$1")
    return F.concat(F.lit("\\A"), F.regexp_replace(quoted, "\\*", "[^\\\\n]*"), F.lit("\\z"))


def _seed_host(labels: Column, exact: Column) -> Column:
    size = F.size(labels)
    stars = F.size(F.filter(labels, lambda label: label == "*"))
    last_star = size - F.array_position(F.reverse(labels), "*") + 1
    tail = F.when(stars == 0, labels).otherwise(F.slice(labels, last_star + 1, size))
    return F.when(F.size(tail) == 0, exact).otherwise(F.array_join(tail, "."))


def parse_targets(raws: Column) -> Column:
    """Array of target strings to an array of scope structs.

    ``error`` is null for a usable target; ``seeds`` are its start URLs.
    """
    steps = F.transform(raws, lambda raw: F.struct(trim_space(raw).alias("raw")))
    steps = F.transform(
        steps,
        lambda s: F.struct(
            s["raw"].alias("raw"),
            F.when(F.contains(s["raw"], F.lit("://")), F.substring_index(s["raw"], "://", 1)).otherwise("").alias("scheme"),
            F.contains(s["raw"], F.lit("://")).alias("has_scheme"),
        ),
    )
    steps = F.transform(
        steps,
        lambda s: s.withField("rest", F.when(s["has_scheme"], urls.after(s["raw"], s["scheme"], 3)).otherwise(s["raw"])),
    )
    steps = F.transform(
        steps,
        lambda s: s.withField("host", F.substring_index(s["rest"], "/", 1)).withField(
            "path_pattern",
            F.when(F.contains(s["rest"], F.lit("/")), trim_space(urls.after(s["rest"], F.substring_index(s["rest"], "/", 1)))).otherwise("/*"),
        ),
    )
    steps = F.transform(
        steps,
        lambda s: s.withField("host", trim_space(s["host"])),
    )
    steps = F.transform(
        steps,
        lambda s: s.withField("port", F.regexp_extract(s["host"], "\\A(?:[^:\\[\\]]*|\\[[^\\[\\]]*\\]):([^:\\[\\]]*)\\z", 1))
        .withField(
            "name",
            F.coalesce(
                F.nullif(F.regexp_extract(s["host"], "\\A([^:\\[\\]]*):[^:\\[\\]]*\\z", 1), F.lit("")),
                F.nullif(F.regexp_extract(s["host"], "\\A\\[([^\\[\\]]*)\\]:[^:\\[\\]]*\\z", 1), F.lit("")),
                F.when(s["host"].rlike("\\A:[^:\\[\\]]*\\z"), F.lit("")).otherwise(s["host"]),
            ),
        ),
    )
    steps = F.transform(
        steps,
        lambda s: s.withField("name", F.lower(s["name"])).withField("labels", F.split(F.lower(s["name"]), "\\.", -1)),
    )

    def finish(s: Column) -> Column:
        schemes = F.when(s["scheme"] == "", F.array(F.lit("https"), F.lit("http"))).otherwise(F.array(F.lower(s["scheme"])))
        host = _seed_host(s["labels"], s["name"])
        joined = F.when(
            s["port"] != "",
            F.concat(F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.lit(":"), s["port"]),
        ).otherwise(host)
        error = (
            F.when(s["raw"] == "", "no target was given")
            .when(s["rest"] == "", "nothing follows the scheme")
            .when(s["host"] == "", "no host before the path")
            .when(F.array_contains(s["labels"], ""), "a label of the host is empty")
        )
        return F.struct(
            s["raw"].alias("raw"),
            schemes.alias("schemes"),
            s["name"].alias("host_exact"),
            s["labels"].alias("host_labels"),
            s["port"].alias("port"),
            s["path_pattern"].alias("path_pattern"),
            _path_regex(s["path_pattern"]).alias("path_regex"),
            F.contains(s["raw"], F.lit("*")).alias("wildcard"),
            F.transform(
                schemes, lambda scheme: F.concat(scheme, F.lit("://"), joined, F.substring_index(s["path_pattern"], "*", 1))
            ).alias("seeds"),
            error.alias("error"),
        )

    return F.transform(steps, finish)


def parse_target(raw: Column) -> Column:
    """Scope struct of one target string."""
    return F.element_at(parse_targets(F.array(raw)), 1)


@built_once
def scope_of(name: str) -> Column:
    """Scope struct of the target column ``name``."""
    return parse_target(F.col(name))


def literal_scope(spark: SparkSession, raw: str) -> Column:
    """Scope struct of one known target as literals, so its tests fold and its
    path pattern compiles once per task.  An unusable target fails here."""
    row = spark.range(1).select(F.lit(raw).alias("raw")).select(scope_of("raw").alias("scope")).first()["scope"]
    if row["error"]:
        raise ValueError(f"{row['error']}: {raw}")

    def literal(value) -> Column:
        return F.array(*(F.lit(v) for v in value)) if isinstance(value, list) else F.lit(value)

    return F.struct(*(literal(row[name]).alias(name) for name in row.asDict() if name != "error"))


def scope_matches(scope: Column, url: Column) -> Column:
    """True where parsed URL parts lie inside a scope.

    ``url`` is a struct from :mod:`sievenet.functions.urls`.
    """
    labels, want = F.split(F.lower(url["hostname"]), "\\.", -1), scope["host_labels"]
    agree = F.zip_with(
        labels, want, lambda label, wanted: F.when(wanted == "*", label != "").otherwise(label == wanted)
    )
    by_label = (F.size(labels) == F.size(want)) & F.forall(agree, lambda ok: ok)
    host = F.when(F.contains(scope["host_exact"], F.lit("*")), by_label).otherwise(
        F.lower(url["hostname"]) == scope["host_exact"]
    )
    port = F.when(scope["port"] != "", url["port"] == scope["port"]).otherwise(
        (url["port"] == "") | F.contains(scope["raw"], F.lit("*"))
    )
    path = F.when(url["escaped_path"] == "", F.lit("/")).otherwise(url["escaped_path"])
    return (
        (url["hostname"] != "")
        & F.array_contains(scope["schemes"], url["scheme"])
        & port
        & host
        & F.rlike(path, scope["path_regex"])
    )


def url_in_scope(scope: Column, url: Column) -> Column:
    """Scope test of a URL string; unparsable URLs are outside."""
    parts = urls.parse_all(F.array(url))
    return F.exists(parts, lambda p: p["valid"] & scope_matches(scope, p))


@built_once
def _in_scope(scope: str, parts: str) -> Column:
    return F.col(f"{parts}.valid") & scope_matches(F.col(scope), F.col(parts))


def where_in_scope(rows: DataFrame, scope: str, url: str) -> DataFrame:
    """Rows whose URL column lies in their scope column."""
    columns = rows.columns
    parsed = rows.withColumn("_parts", urls.parts_of(url))
    return parsed.where(_in_scope(scope, "_parts")).select(*columns)


@built_once
def admits(scope: str, parts: str) -> Column:
    """Scope test of parsed parts, both given by column name."""
    return scope_matches(F.col(scope), F.col(parts))


def build_frontier(requests: DataFrame, scope: str | None = None, *, order: str = "req_ord") -> DataFrame:
    """Seed queue of a run.

    With ``scope`` the requests are fetched as they are; otherwise each
    request is its own scope and stands for that scope's seeds.  The queue is
    ordered by ``queue_ord``, the request's order, then ``seed_ord``.  An unusable
    target fails the run.
    """
    one = scope.strip() if scope else ""
    rows = requests.withColumn("_target", F.lit(one) if one else F.col("url")).withColumn("scope", scope_of("_target"))
    usable = F.when(F.col("scope.error").isNull(), F.col("scope.raw"))
    checked = usable.otherwise(
        F.raise_error(F.concat(F.col("scope.error"), F.lit(": "), F.col("scope.raw"))).cast("string")
    )
    seeds = F.array("url") if one else F.col("scope.seeds")
    method = F.coalesce(F.nullif(F.trim("method"), F.lit("")), F.lit("GET"))
    return rows.select("*", F.posexplode(seeds).alias("_seed", "_url")).select(
        F.col(order).cast("bigint").alias("queue_ord"),
        F.col("_seed").alias("seed_ord"),
        F.lit(0).alias("depth"),
        method.alias("method"),
        F.col("_url").alias("url"),
        F.col("headers"),
        checked.alias("target_url"),
        F.lit("").alias("discovered_from"),
        F.col("scope"),
    )


def discovery_is_on(frontier: DataFrame) -> bool:
    """One wildcard target turns discovery on for the whole run."""
    row = frontier.agg(F.bool_or(F.contains("target_url", F.lit("*"))).alias("on")).first()
    return bool(row and row["on"])
