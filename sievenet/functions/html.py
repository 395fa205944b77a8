"""Links of HTML bodies, read by a tokenizing pattern instead of a parser.

One pattern walks a body from markup item to markup item: comments,
declarations, elements whose content is text (``script``, ``style`` ...) and
tags with their quoted attributes are each consumed whole, so markup inside
them is not mistaken for an element.  It runs in the JVM, once per body.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = "\\t\\n\\f\\r "
_VALUE = f"(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^{_WS}>]++|(?=>))"
_ATTRIBUTE = f"[^{_WS}/>][^{_WS}/>=]*+(?:[{_WS}]*+=[{_WS}]*+{_VALUE}|(?![{_WS}]*+=))"
_REST_OF_TAG = f"(?=[{_WS}/>])(?:[{_WS}/]++|{_ATTRIBUTE})*+>"
_TEXT_ELEMENTS = "script|style|title|textarea|xmp|iframe|noembed|noframes|noscript"

_MARKUP = (
    "(?i)"
    f"(?:(?=(<(?:script|link|a){_REST_OF_TAG}))|(?=<))"
    "(?:"
    "<!--(?:-?>|(?s:.*?)(?:--!?>|\\z))"
    f"|<({_TEXT_ELEMENTS}){_REST_OF_TAG}(?s:.*?)(?=</\\2[{_WS}/>]|\\z)"
    f"|<plaintext{_REST_OF_TAG}(?s:.*+)"
    f"|</?[a-z][^{_WS}/>]*+{_REST_OF_TAG}"
    "|</?[a-z](?s:.*+)"
    "|<[!?/][^>]*+>?"
    ")"
)


@lru_cache(maxsize=1)
def _named_entities() -> str:
    return json.dumps(html5)


def _numeric_replacements() -> dict[str, str]:
    """Code points 128-159 stand for their Windows-1252 characters."""
    pairs = {}
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", "ignore")
        if char:
            pairs[str(code)] = char
    return pairs


def decode_entities(text: Column) -> Column:
    """Character references in an attribute value, decoded."""
    tokens = F.regexp_extract_all(
        text,
        F.lit("&#[xX][0-9A-Fa-f]++;?|&#[0-9]++;?|&[0-9A-Za-z]++(?:;|(?!=))|[^&]+|&"),
        F.lit(0),
    )
    named = F.from_json(F.lit(_named_entities()), "map<string,string>")
    windows = F.from_json(F.lit(json.dumps(_numeric_replacements())), "map<string,string>")

    def decode(token: Column) -> Column:
        is_hex = token.rlike("\\A&#[xX]")
        digits = F.regexp_extract(token, "([0-9A-Fa-f]+);?\\z", 1)
        number = F.conv(F.right(F.concat(F.lit("0" * 9), digits), F.lit(9)), 16, 10)
        decimal = F.regexp_extract(digits, "\\A0*(.*)\\z", 1)
        code = F.when(is_hex, number).otherwise(decimal)
        value = F.when(F.char_length(code) > 8, F.lit(-1)).otherwise(F.coalesce(F.try_to_number(code, F.lit("99999999")).cast("int"), F.lit(0)))
        bad = (value <= 0) | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        return (
            F.when(
                token.rlike("\\A&#"),
                F.when(bad, F.lit("\ufffd")).otherwise(F.coalesce(F.element_at(windows, code), char)),
            )
            .when(token.rlike("\\A&."), F.coalesce(F.element_at(named, F.substr(token, F.lit(2))), token))
            .otherwise(token)
        )

    decoded = F.array_join(F.transform(tokens, decode), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of the first attribute ``name`` of a tag, or null."""
    attributes = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
    named = F.get(F.filter(attributes, lambda a: a.rlike(f"\\A(?i:{name})(?:[{_WS}=]|\\z)")), F.lit(0))
    raw = F.regexp_extract(named, f"\\A.[^=]*+=[{_WS}]*+((?s:.*))\\z", 1)
    bare = F.when(raw.rlike("\\A[\"']"), F.substring(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(raw)
    return decode_entities(bare)


def html_links(body: Column) -> Column:
    """``script[src]`` values, then ``link[href]`` and ``a[href]`` values."""
    tags = F.filter(F.regexp_extract_all(body, F.lit(_MARKUP), F.lit(1)), lambda tag: tag != "")
    picked = F.transform(
        tags,
        lambda tag: F.when(tag.rlike("\\A(?i:<script)"), F.struct(F.lit(0).alias("rank"), attribute(tag, "src").alias("value")))
        .otherwise(F.struct(F.lit(1).alias("rank"), attribute(tag, "href").alias("value"))),
    )
    # One pass: scripts collect in front of the other links.
    split = F.aggregate(
        F.filter(picked, lambda p: p["value"].isNotNull()),
        F.struct(F.array().cast("array<string>").alias("first"), F.array().cast("array<string>").alias("rest")),
        lambda acc, p: F.struct(
            F.when(p["rank"] == 0, F.array_append(acc["first"], p["value"])).otherwise(acc["first"]).alias("first"),
            F.when(p["rank"] == 0, acc["rest"]).otherwise(F.array_append(acc["rest"], p["value"])).alias("rest"),
        ),
        lambda acc: F.concat(acc["first"], acc["rest"]),
    )
    return split
