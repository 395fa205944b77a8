"""Text helpers: body decoding, trimming, extensions, kinds and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_RADIUS = 80

# The characters Unicode counts as white space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]+"


def as_text(value: Column) -> Column:
    """Bytes (or text) as valid text; ill-formed UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(value.cast("string"))


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(SPACES))


def fields(text: Column) -> Column:
    """Split on runs of Unicode white space, without empty pieces."""
    return F.filter(F.split(text, SPACE_RUN), lambda piece: piece != "")


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path segment, dot included, or ''."""
    return F.lower(extension_as_written(path))


def extension_as_written(path: Column) -> Column:
    return F.regexp_extract(path, "(\\.[^./]*)\\z", 1)


def first_case(cases, default: str) -> Column:
    """The value of the first true condition in ``(condition, value)`` pairs."""
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(default))


def content_type_from_path(path: Column) -> Column:
    """Content type a saved file is given when no manifest states one."""
    ext = extension(path)
    # Content types by extension.
    by_type = {
        "text/html": (".html", ".htm", ".php", "."),
        "application/javascript": (".js", ".mjs"),
        "application/json": (".json",),
        "application/xml": (".xml",),
        "text/css": (".css",),
        "text/plain": (".txt",),
    }
    return first_case([(ext.isin(*exts), t) for t, exts in by_type.items()], "application/octet-stream")


def resource_kind(content_type: Column, final_url: Column) -> Column:
    """Kind from the content type, else from the extension of the whole URL."""
    lowered, ext = F.lower(content_type), extension(final_url)
    # Kinds by words of the content type, then by extension.
    by_content = (
        ("html", ("html",)),
        ("js", ("javascript", "ecmascript")),
        ("json", ("json",)),
        ("xml", ("xml",)),
        ("css", ("css",)),
        ("text", ("text",)),
    )
    by_extension = (
        ("html", (".html", ".htm")),
        ("js", (".js", ".mjs")),
        ("json", (".json",)),
        ("xml", (".xml",)),
        ("css", (".css",)),
        ("map", (".map",)),
        ("text", (".txt",)),
    )
    cases = [(lowered.rlike("|".join(words)), kind) for kind, words in by_content]
    cases += [(ext.isin(*exts), kind) for kind, exts in by_extension]
    return first_case(cases, "unknown")


def with_context(rows: DataFrame, line: str, match: str, name: str, radius: int = CONTEXT_RADIUS) -> DataFrame:
    """Add ``radius`` bytes around the first occurrence of ``match`` in ``line``.

    Staged in three projections so that the byte offset is searched for once.
    """
    if radius <= 0:
        return rows.withColumn(name, trim_space(F.col(line)))
    before = F.octet_length(F.call_function("substring_index", F.col(line), F.col(match), F.lit(1)))
    empty = F.col(match) == ""
    start, end, size = F.col("_start"), F.col("_end"), F.octet_length(line)
    cut = as_text(F.substring(F.col(line).cast("binary"), start + 1, end - start))
    columns = rows.columns
    offsets = rows.withColumn("_before", before).select(
        *columns,
        F.when(empty, 0).otherwise(F.greatest(F.col("_before") - F.lit(radius), F.lit(0))).alias("_start"),
        F.when(empty, size)
        .otherwise(F.least(F.col("_before") + F.octet_length(match) + F.lit(radius), size))
        .alias("_end"),
    )
    return offsets.select(
        *columns,
        F.concat(
            F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
            trim_space(cut),
            F.when(end < size, F.lit("...")).otherwise(F.lit("")),
        ).alias(name),
    )
