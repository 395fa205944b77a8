"""Named patterns: parsing, precedence, selection and assembly.

A pattern list is short by nature, lives on the driver and ends up as literals
in the plan.  Catalogs kept as tables are parsed with :func:`parse_catalog`.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievenet.functions.text import trim_space

CUSTOM_SOURCE = "custom:cli --pattern"


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    source: str = CUSTOM_SOURCE
    description: str = ""


# The packaged patterns, one "name || regex" per line.
PACKAGED = r"""
JWT || eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9._-]+\.[A-Za-z0-9._-]+
email || [A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}
URL || https?://[^\s\"'<>]+
internal API path || /api/[A-Za-z0-9_./?&=-]+
JSON endpoint || https?://[^\s\"']+\.json(?:\?[^\s\"']*)?
Swagger/OpenAPI spec || https?://[^\s\"']*(?:swagger|openapi)[^\s\"']*\.json(?:\?[^\s\"']*)?|/[A-Za-z0-9._/-]*(?:swagger|openapi)[A-Za-z0-9._/-]*\.json
Swagger/OpenAPI path || "(?:/[^"\s{}]+)+":\s*\{
GraphQL endpoint || https?://[^\s\"']*(?:graphql|gql)[^\s\"']*|/[A-Za-z0-9/_-]*(?:graphql|gql)[A-Za-z0-9/_-]*
API key-like string || (?i)(?:api[_-]?key|token|secret)[\"'\s:=]+[A-Za-z0-9_\-]{16,}
"""


class PatternFileError(ValueError):
    """A pattern file has a line that is not ``name || regex``."""


def _definitions(text: str, origin: str) -> list[Pattern]:
    found = []
    for number, raw in enumerate(text.split("\n"), start=1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        name, bars, regex = (part.strip() for part in line.partition("||"))
        if not (bars and name and regex):
            raise PatternFileError(f"invalid pattern line {number} in {origin}")
        found.append(Pattern(name, regex, f"builtin:{origin}:{name}"))
    return found


def packaged_patterns() -> list[Pattern]:
    return _definitions(PACKAGED, "embedded")


def load_patterns(spark: SparkSession, paths: Sequence[str] = ()) -> list[Pattern]:
    """Patterns of the first readable, valid file; else the packaged ones."""
    for path in dict.fromkeys(p for p in paths if p):
        try:
            rows = spark.read.text(path, wholetext=True).collect()
            return _definitions("\n".join(row.value for row in rows), path)
        except PatternFileError:
            continue
        except Exception as error:  # an unreadable candidate passes to the next one
            if "PATH_NOT_FOUND" not in str(error) and "FileNotFound" not in str(error):
                raise
    return packaged_patterns()


def find_by_names(patterns: Iterable[Pattern], names: Iterable[str]) -> list[Pattern]:
    """Patterns with these exact names, in asked order; unknown names vanish."""
    by_name = {pattern.name: pattern for pattern in patterns}
    return [by_name[name] for name in names if name in by_name]


def assemble(
    builtins: Sequence[Pattern] = (),
    custom: Sequence[str] = (),
    *,
    builtin_alias_custom: bool = False,
) -> list[Pattern]:
    """Builtins first, then custom regexes; identical definitions once.

    ``builtin_alias_custom`` also adds each builtin regex as a custom pattern,
    which shows only in scans without dedup.
    """
    regexes = [*custom, *(p.regex for p in builtins)] if builtin_alias_custom else list(custom)
    listed = [*builtins, *(Pattern("custom", regex) for regex in regexes)]
    unique = list({(p.regex, p.name, p.source): p for p in reversed(listed)}.values())[::-1]
    if not unique:
        raise ValueError("neither packaged nor custom patterns were chosen")
    return unique


def parse_catalog(lines: DataFrame, *, by: str = "file", order: str = "line_no", text: str = "value") -> DataFrame:
    """Parse ``name || regex`` lines of many pattern files.

    Blank and ``#`` lines go; ``valid`` tells whether the whole file parses
    (one bad line makes a file unusable).  The per-file verdict is aggregated
    from narrow rows and joined back, so a large file stays spread out.
    """
    line = trim_space(F.col(text))
    bar = F.instr(F.col("_line"), "||")
    rows = (
        lines.select(F.col(by), F.col(order), line.alias("_line"))
        .where((F.col("_line") != "") & ~F.startswith("_line", F.lit("#")))
        .select(
            by,
            order,
            trim_space(F.when(bar > 0, F.substring_index("_line", "||", 1)).otherwise("")).alias("name"),
            trim_space(F.when(bar > 0, F.substr("_line", bar + 2)).otherwise("")).alias("regex"),
        )
    )
    bad = (F.col("name") == "") | (F.col("regex") == "")
    broken = rows.where(bad).select(by).distinct().withColumn("_broken", F.lit(True))
    return rows.join(broken, by, "left").select(
        by, order, "name", "regex", F.col("_broken").isNull().alias("valid")
    )


def select_patterns(catalog: DataFrame, names: DataFrame, *, order: str = "line_no") -> DataFrame:
    """Table form of :func:`find_by_names`: last definition per name, asked order."""
    last = catalog.groupBy("name").agg(F.max_by("regex", order).alias("regex"))
    return names.join(last, "name")
