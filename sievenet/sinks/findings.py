"""Findings as text, CSV, JSON lines or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievenet.operators.scan import ORDER_COLUMNS

KINDS = ("plain", "json", "csv", "parquet")

# A reader keeps quotes, blanks and empty values exactly as they were found.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}

_JSON_ESCAPES = {"&": "\\u0026", "<": "\\u003c", ">": "\\u003e", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def resolve_kind(output: str) -> str:
    """Output kind named outright or by a file ending; anything else is plain."""
    output = output.strip()
    if output in KINDS:
        return output
    ending = output.rpartition("/")[2].rpartition(".")[2].lower()
    return ending if ending in ("json", "csv") else "plain"


def output_kind(output: Column) -> Column:
    """:func:`resolve_kind` of a column of outputs."""
    name = F.trim(output)
    ending = F.lower(F.regexp_extract(name, r"\.([^./]*)\z", 1))
    return F.when(name.isin(*KINDS), name).when(ending.isin("json", "csv"), ending).otherwise("plain")


def _strings(findings: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in findings.columns]


def plain_lines(findings: DataFrame) -> DataFrame:
    """Fields joined by tabs, in column order."""
    return findings.select(F.concat_ws("\t", *_strings(findings)).alias("value"))


def json_lines(findings: DataFrame) -> DataFrame:
    """One object per row: sorted keys, string values, HTML characters escaped."""
    text = F.to_json(F.struct(*(c for _, c in sorted(zip(findings.columns, _strings(findings)), key=lambda p: p[0]))))
    for char, escape in _JSON_ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    return findings.select(text.alias("value"))


def _writer_input(findings: DataFrame, kind: str) -> tuple[DataFrame, str, dict[str, str]]:
    if kind == "plain":
        return plain_lines(findings), "text", {}
    if kind == "json":
        return json_lines(findings), "text", {}
    if kind == "csv":
        return findings.select(*_strings(findings)), "csv", CSV_OPTIONS
    if kind == "parquet":
        return findings, "parquet", {}
    raise ValueError(f"findings can't be written as {kind!r}")


def write_findings(findings: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists") -> None:
    frame, source, options = _writer_input(findings, kind or resolve_kind(path))
    frame.write.format(source).options(**options).mode(mode).save(path)


def write_report(findings: DataFrame, path: str, kind: str | None = None, lead: Sequence[str] = ("resource_url",), fields: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """Findings in report order: the numbered part files, one after the other, are sorted.

    Rows go by ``lead`` (``queue_ord`` after a crawl), line, value, and the place of pattern and match. Ranges are cut
    on all of these, so that one resource with very many findings is spread over parts as well.
    ``findings`` needs those columns; ``fields`` are written, all others if not given.
    """
    order = [*lead, *ORDER_COLUMNS]
    hidden = ("pattern_ord", "match_ord", *(c for c in lead if c not in ("resource_url",)))
    names = list(fields) if fields is not None else [c for c in findings.columns if c not in hidden]
    write_findings(findings.orderBy(*order).select(*names), path, kind, mode)


def stream_findings(findings: DataFrame, path: str, checkpoint: str, kind: str | None = None, **trigger):
    """Append findings as their captures arrive; returns the running query."""
    frame, source, options = _writer_input(findings, kind or resolve_kind(path))
    return (
        frame.writeStream.format(source)
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
