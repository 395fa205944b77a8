"""Stable relative file paths for captured URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievenet.functions import urls
from sievenet.functions.built import built_once
from sievenet.functions.text import as_text, extension_as_written, first_case, trim_space

MAX_PART = 96
_HASH_SUFFIX = 10


def _digest(text: Column) -> Column:
    return F.concat(F.lit("__"), F.left(F.sha1(text.cast("binary")), F.lit(8)))


def shorten(part: Column) -> Column:
    """Parts over 96 bytes keep 86 bytes and gain a digest."""
    head = as_text(F.substring(part.cast("binary"), 1, MAX_PART - _HASH_SUFFIX))
    return F.when(F.octet_length(part) <= MAX_PART, part).otherwise(F.concat(head, _digest(part)))


def sanitize(part: Column) -> Column:
    """A path part safe as a file name."""
    cleaned = F.btrim(F.translate(trim_space(part), ":?&=*\\", "______"), F.lit(" ."))
    return F.when(cleaned == "", F.lit("_")).otherwise(shorten(cleaned))


def clean_parts(path: Column) -> Column:
    """Segments of a rooted path without empty and dot segments."""
    parts = F.filter(F.split(path, "/", -1), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(
            F.array_append(kept, part)
        ),
    )
    return F.when(F.exists(parts, lambda p: p == ".."), folded).otherwise(parts)


def default_extension(content_type: Column) -> Column:
    lowered = F.lower(content_type)
    # Extensions by words of the content type.
    by_type = (
        (".html", "html"),
        (".js", "javascript|ecmascript"),
        (".json", "json"),
        (".xml", "xml"),
        (".css", "css"),
        (".txt", "plain|text"),
    )
    return first_case([(lowered.rlike(words), ext) for ext, words in by_type], ".bin")


def with_relative_path(captures: DataFrame, name: str = "relative_path") -> DataFrame:
    """Add the path a capture is saved under, from ``final_url`` and type.

    An URL without a path is saved as ``index.``, ``/`` as ``index`` with an
    extension by type; queries become a digest before the extension.
    """
    columns = captures.columns
    parts, dirs, file_stem, extra, file, path = _stages()
    return (
        captures.select(*columns, urls.parts_of("final_url").alias("_url"))
        .select(*columns, "_url", parts.alias("_parts"))
        .select(*columns, "_url", dirs.alias("_dirs"), file_stem.alias("_file"), extra.alias("_ext"))
        .select(*columns, "_url", "_dirs", "_ext", file.alias("_file"))
        .select(*columns, path.alias(name))
    )


@built_once
def _stages() -> tuple[Column, ...]:
    last = F.element_at("_parts", -1)
    by_type = default_extension(F.col("content_type"))
    dirs = F.when(F.size("_parts") > 1, F.slice("_parts", F.lit(1), F.size("_parts") - 1)).otherwise(
        F.array().cast("array<string>")
    )
    file_stem = F.when(F.size("_parts") > 0, sanitize(last))
    extra = (
        F.when(F.size("_parts") > 0, F.coalesce(F.nullif(extension_as_written(last), F.lit("")), by_type))
        .when(F.col("_url.escaped_path") == "", F.lit("."))
        .otherwise(by_type)
    )
    named = F.col("_file")
    file = F.when(extension_as_written(named) == "", F.concat("_file", "_ext")).otherwise(named)
    ext = extension_as_written(named)
    base = F.substr("_file", F.lit(1), F.char_length("_file") - F.char_length(ext))
    hashed = F.concat(shorten(base), _digest(F.col("_url.query")), ext)
    leaf = (
        F.when(named.isNull(), F.concat(F.lit("index"), F.col("_ext")))
        .when(F.col("_url.query") != "", hashed)
        .otherwise(named)
    )
    host = F.array(sanitize(F.col("_url.host")))
    joined = F.array_join(F.concat(host, F.transform("_dirs", sanitize), F.array(leaf)), "/")
    # Never null, so a join on the path infers no filter that repeats all this.
    path = F.coalesce(joined, F.lit(""))
    return clean_parts(F.col("_url.escaped_path")), dirs, file_stem, extra, file, path
