"""Multi-pattern scan of captured bodies: one narrow stage, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievenet.functions import text as T
from sievenet.functions.regex import SparkRegex, to_spark_regex
from sievenet.schemas import DEFAULT_FIELDS, FINDING_FIELDS
from sievenet.sources.patterns import Pattern

ORDER_COLUMNS = ("line", "matched_value", "pattern_ord", "match_ord")


def parse_fields(raw: str) -> list[str]:
    """Field list from ``a,b,c``: trimmed, blanks skipped, repeats allowed."""
    names = [name.strip() for name in raw.split(",")]
    return check_fields([name for name in names if name])


def check_fields(names: Sequence[str]) -> list[str]:
    for name in names:
        if name not in FINDING_FIELDS:
            raise ValueError(f"findings have no field {name!r}; fields are {', '.join(FINDING_FIELDS)}")
    if not names:
        raise ValueError("name one field of the findings at least")
    return list(names)


def lines(captures: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """One row per line of each body: ``keep`` columns, ``line`` and ``text``."""
    pieces = F.split(T.as_text(F.col(body)), "\n", -1)
    return captures.select(*keep, F.posexplode(pieces).alias("_pos", "text")).select(
        *keep, (F.col("_pos") + 1).cast("int").alias("line"), "text"
    )


def _holds(text: Column, regex: SparkRegex) -> Column | None:
    """True where ``text`` has the literals a match needs; None if unknown."""
    if not regex.needs:
        return None
    clauses = [
        reduce(lambda a, b: a | b, [F.contains(text, F.lit(word)) for word in sorted(words)])
        for words in regex.needs
    ]
    return reduce(lambda a, b: a & b, clauses)


def _possible(rows: DataFrame, text: str, compiled) -> DataFrame:
    """Drop bodies, then lines, that lack what every pattern needs."""
    guards = [_holds(F.col(text), regex) for _, _, regex in compiled]
    if any(guard is None for guard in guards):
        return rows
    return rows.where(reduce(lambda a, b: a | b, guards))


def _matches(line: Column, regex: SparkRegex, dedup: bool) -> Column:
    found = F.regexp_extract_all(line, F.lit(regex.java), F.lit(0))
    if dedup:
        found = F.array_distinct(found)
    guard = _holds(line, regex)
    return found if guard is None else F.when(guard, found)


def _without_repeated_regex(patterns: Iterable[tuple[int, Pattern]]) -> list[tuple[int, Pattern]]:
    first: dict[str, tuple[int, Pattern]] = {}
    for ordinal, pattern in patterns:
        first.setdefault(pattern.regex, (ordinal, pattern))
    return list(first.values())


def scan(
    captures: DataFrame,
    patterns: Sequence[Pattern],
    *,
    dedup: bool = True,
    fields: Sequence[str] = DEFAULT_FIELDS,
    keep: Sequence[str] = (),
    radius: int = T.CONTEXT_RADIUS,
) -> DataFrame:
    """Findings of every pattern on every line of every body.

    ``captures`` needs ``body`` and the columns the requested ``fields`` use;
    the rest is never read.  With ``dedup`` a value is reported once per line
    and regex (the first pattern with that regex names it), which is local to
    a line, so neither form shuffles.  ``keep`` passes further columns through:
    capture columns, or ``pattern_ord`` / ``match_ord`` for a stable order.
    """
    if not patterns:
        raise ValueError("a scan needs a pattern")
    fields = check_fields(fields)
    numbered = list(enumerate(patterns))
    if dedup:
        numbered = _without_repeated_regex(numbered)
    compiled = [(ordinal, p, to_spark_regex(p.regex)) for ordinal, p in numbered]

    lineage = {
        "target_url": F.col("target_url"),
        "resource_url": F.col("final_url"),
        "discovered_from": F.col("parent_url"),
        "status": F.col("status"),
        "content_type": F.col("content_type"),
        "resource_kind": T.resource_kind(F.col("content_type"), F.col("final_url")),
    }
    hidden = ("pattern_ord", "match_ord")
    wanted = dict.fromkeys(fields)
    carried = [lineage[name].alias(name) for name in wanted if name in lineage]
    through = [name for name in keep if name not in hidden and name not in wanted]
    names = [*through, *(name for name in wanted if name in lineage)]

    body = T.as_text(F.col("body"))
    rows = _possible(captures.select(*through, *carried, body.alias("_text")), "_text", compiled)
    split = rows.select(*names, F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    per_line = _possible(split, "_line", compiled)

    hits = F.array(
        *(
            F.struct(
                F.lit(ordinal).alias("pattern_ord"),
                F.lit(p.name).alias("pattern_name"),
                F.lit(p.source).alias("pattern_source"),
                F.lit(p.regex).alias("pattern"),
                _matches(F.col("_line"), regex, dedup).alias("values"),
            )
            for ordinal, p, regex in compiled
        )
    )
    per_pattern = per_line.select(*names, "_pos", "_line", F.explode(hits).alias("_hit"))
    findings = per_pattern.select(
        *names, "_pos", "_line", "_hit", F.posexplode("_hit.values").alias("match_ord", "matched_value")
    )
    if "context" in wanted:
        findings = T.with_context(findings, "_line", "matched_value", "context", radius)
        names = [*names, "context"]
    computed = {
        **{name: F.col(name) for name in (*names, "matched_value", "match_ord")},
        **{f: F.col(f"_hit.{f}") for f in ("pattern", "pattern_name", "pattern_source", "pattern_ord")},
        "line": (F.col("_pos") + 1).cast("int"),
    }
    return findings.select(*(computed[name].alias(name) for name in [*fields, *(k for k in keep if k not in wanted)]))


def top_findings(findings: DataFrame, limit: int, lead: Sequence[str] = ("resource_url",)) -> DataFrame:
    """First ``limit`` findings in report order (a top-k, not a full sort)."""
    return findings.orderBy(*lead, *ORDER_COLUMNS).limit(limit)
