"""Exclusion rules: file categories and URL wildcards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievenet.functions.regex import wildcard
from sievenet.functions.text import extension

# Extensions of the exclusion categories.
CATEGORIES = {
    "images": (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".bmp", ".ico", ".avif"),
    "css": (".css",),
    "video": (".mp4", ".mov", ".avi", ".webm", ".mkv", ".m4v"),
}
# Accepted as a category name, but it excludes nothing.
_INERT = ("image",)


def out_of_scope(rules: Sequence[str], url: Column, path: Column) -> Column:
    """True where a rule excludes the URL (``path`` is its decoded path)."""
    excluded, patterns = [], []
    for rule in (r.strip().lower() for r in rules):
        if rule in CATEGORIES:
            excluded.extend(CATEGORIES[rule])
        elif rule and rule not in _INERT:
            patterns.append(F.lower(url).rlike(wildcard(rule)))
    tests = [extension(path).isin(*excluded)] if excluded else []
    return reduce(lambda a, b: a | b, tests + patterns, F.lit(False))
