"""URL parsing, escaping and reference resolution as Column expressions.

``parse_all`` and ``resolve_all`` work on arrays of URLs.  Each step is a
``transform`` whose result is a struct, so a field computed once is only read
by later steps, and a page's links are resolved inside its row: no explode, no
shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievenet.functions.built import built_once

# Characters a URL part may hold unescaped.
_PATH_SAFE = "A-Za-z0-9\\-_.~$&+,/:;=@"
_PATH_LEGAL = f"\\A(?:[{_PATH_SAFE}!'()*\\[\\]]|%[0-9A-Fa-f]{{2}})*+\\z"
_FRAGMENT_SAFE = "A-Za-z0-9\\-_.~$&+,/:;=?@!()*"
_FRAGMENT_LEGAL = f"\\A(?:[{_FRAGMENT_SAFE}'\\[\\]]|%[0-9A-Fa-f]{{2}})*+\\z"
_HOST_SAFE = "A-Za-z0-9\\-_.~!$&'()*+,;=:\\[\\]<>\""
_HOST_LEGAL = f"\\A(?:[{_HOST_SAFE}]|[^\\x{{0}}-\\x{{7f}}]|%(?:25|[89A-Fa-f][0-9A-Fa-f]))*+\\z"
_USER_LEGAL = "\\A(?:[A-Za-z0-9\\-._:~!$&'()*+,;=@]|%[0-9A-Fa-f]{2})*+\\z"
_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"


def _matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def after(text: Column, prefix: Column, skip: int = 0) -> Column:
    """What follows ``prefix`` plus ``skip`` characters."""
    return F.substring(text, F.char_length(prefix) + F.lit(1 + skip), F.char_length(text))


def _with(struct: Column, **columns: Column) -> Column:
    for name, column in columns.items():
        struct = struct.withField(name, column)
    return struct


def _escape(text: Column, safe: str) -> Column:
    """Percent-decode, then encode every byte outside ``safe``."""
    tokens = F.regexp_extract_all(text, F.lit(f"%[0-9A-Fa-f]{{2}}|[{safe}]++|(?:(?!%[0-9A-Fa-f]{{2}})[^{safe}])+"), F.lit(0))

    def encode(token: Column) -> Column:
        is_escape = token.rlike("\\A%[0-9A-Fa-f]{2}\\z")
        decoded = F.chr(F.conv(F.substring(token, 2, 2), 16, 10).cast("long"))
        percent = F.regexp_replace(F.hex(token.cast("binary")), "(..)", "%$1")
        return (
            F.when(is_escape, F.when(decoded.rlike(f"\\A[{safe}]\\z"), decoded).otherwise(F.upper(token)))
            .when(token.rlike(f"\\A[{safe}]"), token)
            .otherwise(percent)
        )

    return F.array_join(F.transform(tokens, encode), "")


def _encode(text: Column, safe: str) -> Column:
    """Encode every byte outside ``safe``, existing escapes included."""
    tokens = F.regexp_extract_all(text, F.lit(f"[{safe}]++|[^{safe}]++"), F.lit(0))
    percent = lambda token: F.regexp_replace(F.hex(token.cast("binary")), "(..)", "%$1")
    return F.array_join(
        F.transform(tokens, lambda token: F.when(token.rlike(f"\\A[{safe}]"), token).otherwise(percent(token))), ""
    )


def encode_path(path: Column) -> Column:
    """A path taken literally: ``%`` itself is encoded too."""
    return _encode(path, _PATH_SAFE)


def encode_host(host: Column) -> Column:
    return _encode(host, _HOST_SAFE)


def escape_path(path: Column) -> Column:
    """A legal path as written, any other decoded and encoded as a whole."""
    return F.when(_matches(path, _PATH_LEGAL), path).otherwise(_escape(path, _PATH_SAFE))


def escape_fragment(fragment: Column) -> Column:
    return F.when(_matches(fragment, _FRAGMENT_LEGAL), fragment).otherwise(_escape(fragment, _FRAGMENT_SAFE))


def escape_host(host: Column) -> Column:
    return F.when(_matches(host, f"\\A[{_HOST_SAFE}]*+\\z"), host).otherwise(_escape(host, _HOST_SAFE))


def unescape_path(path: Column) -> Column:
    """Percent-decoded path; ``+`` is an ordinary character."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.when(F.contains(path, F.lit("%")), decoded).otherwise(path)


def without_fragment(url: Column) -> Column:
    """The key captures are looked up by: fragments are never sent."""
    return F.substring_index(url, "#", 1)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 dot-segment removal; the result is rooted unless empty."""

    def step(kept: Column, part: Column) -> Column:
        size = F.size(kept)
        return (
            F.when(part == ".", F.when(size == 0, F.array(F.lit(""))).otherwise(kept))
            .when(part == "..", F.slice(kept, 1, F.greatest(size - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(part)))
        )

    kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    open_end = F.when(_matches(path, "(?:\\A|/)\\.\\.?\\z"), F.lit("/")).otherwise(F.lit(""))
    folded = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), open_end), "\\A//", "/")
    rooted = F.when(path == "", path).when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(_matches(path, "(?:\\A|/)\\.\\.?(?:/|\\z)"), folded).otherwise(rooted)


def parse_all(urls: Column) -> Column:
    """Array of URL strings to an array of part structs.

    Fields: ``raw, scheme, user, has_user, host, hostname, port, path``
    (as written), ``escaped_path, query, has_query, fragment, valid``.
    """
    steps = F.transform(
        urls,
        lambda u: F.struct(u.alias("raw"), F.substring_index(u, "#", 1).alias("main")),
    )
    steps = F.transform(
        steps,
        lambda s: _with(
            s,
            fragment=after(s["raw"], s["main"], 1),
            scheme_raw=F.regexp_extract(s["main"], "\\A([A-Za-z][A-Za-z0-9+.\\-]*):", 1),
            broken=_matches(s["main"], "\\A:|[\\x{0}-\\x{1f}\\x{7f}]"),
        ),
    )
    steps = F.transform(
        steps,
        lambda s: _with(
            s,
            scheme=F.lower(s["scheme_raw"]),
            rest=F.when(s["scheme_raw"] == "", s["main"]).otherwise(after(s["main"], s["scheme_raw"], 1)),
        ),
    )
    steps = F.transform(
        steps,
        lambda s: _with(
            s,
            hier=F.substring_index(s["rest"], "?", 1),
            has_query=F.contains(s["rest"], F.lit("?")),
        ),
    )
    steps = F.transform(
        steps,
        lambda s: _with(
            s,
            query=after(s["rest"], s["hier"], 1),
            has_authority=F.startswith(s["hier"], F.lit("//"))
            & ((s["scheme"] != "") | ~F.startswith(s["hier"], F.lit("///"))),
            opaque=(s["scheme"] != "") & ~F.startswith(s["hier"], F.lit("/")),
        ),
    )
    steps = F.transform(
        steps,
        lambda s: _with(
            s,
            authority=F.when(s["has_authority"], F.regexp_extract(s["hier"], "\\A//([^/]*)", 1)).otherwise(F.lit("")),
        ),
    )
    steps = F.transform(
        steps,
        lambda s: _with(
            s,
            host=F.substring_index(s["authority"], "@", -1),
            has_user=F.contains(s["authority"], F.lit("@")),
            path=F.when(s["opaque"], F.lit(""))
            .when(s["has_authority"], after(s["hier"], s["authority"], 2))
            .otherwise(s["hier"]),
        ),
    )

    def finish(s: Column) -> Column:
        hostname = F.regexp_extract(s["host"], "\\A(.*?)(?::[0-9]*)?\\z", 1)
        user = F.regexp_extract(s["authority"], "\\A(.*)@", 1)
        bad_host = F.when(
            F.startswith(s["host"], F.lit("[")), ~_matches(s["host"], "\\A\\[[^\\]]*\\](?::[0-9]*)?\\z")
        ).otherwise(~_matches(s["host"], _HOST_LEGAL) | _matches(s["host"], ":[0-9]*[^0-9:][^:]*\\z"))
        bad_first = (
            (s["scheme"] == "")
            & ~F.startswith(s["hier"], F.lit("/"))
            & F.contains(F.substring_index(s["hier"], "/", 1), F.lit(":"))
        )
        bad = (
            s["broken"]
            | bad_first
            | bad_host
            | ~_matches(user, _USER_LEGAL)
            | _matches(s["path"], _BAD_ESCAPE)
            | _matches(s["fragment"], _BAD_ESCAPE)
        )
        return F.struct(
            s["raw"].alias("raw"),
            s["scheme"].alias("scheme"),
            user.alias("user"),
            s["has_user"].alias("has_user"),
            s["host"].alias("host"),
            F.regexp_replace(hostname, "\\A\\[(.*)\\]\\z", "$1").alias("hostname"),
            F.regexp_extract(s["host"], ":([0-9]*)\\z", 1).alias("port"),
            s["path"].alias("path"),
            escape_path(s["path"]).alias("escaped_path"),
            s["query"].alias("query"),
            s["has_query"].alias("has_query"),
            s["fragment"].alias("fragment"),
            (~bad).alias("valid"),
        )

    return F.transform(steps, finish)


def parse(url: Column) -> Column:
    """Part struct of one URL."""
    return F.element_at(parse_all(F.array(url)), 1)


@built_once
def parts_of(name: str) -> Column:
    """Part struct of the URL column ``name``."""
    return parse(F.col(name))


def _text(s: Column) -> Column:
    """URL string of a resolved part struct with a scheme and a host."""
    slash = F.when((s["escaped_path"] != "") & ~F.startswith(s["escaped_path"], F.lit("/")), F.lit("/"))
    return F.concat(
        s["scheme"],
        F.lit("://"),
        F.when(s["has_user"], F.concat(s["user"], F.lit("@"))).otherwise(F.lit("")),
        escape_host(s["host"]),
        F.coalesce(slash, F.lit("")),
        s["escaped_path"],
        F.when(s["has_query"], F.concat(F.lit("?"), s["query"])).otherwise(F.lit("")),
        F.when(s["fragment"] != "", F.concat(F.lit("#"), escape_fragment(s["fragment"]))).otherwise(F.lit("")),
    )


def resolve_all(base: Column, references: Column) -> Column:
    """Resolve an array of references against a parsed base (RFC 3986).

    Returns part structs with the absolute ``url`` added; references that do
    not parse, or resolve to something without scheme and host, are dropped.
    ``same_page`` marks references that stand for the page itself (``#``).
    """

    def pick(r: Column) -> Column:
        own = (r["scheme"] != "") | (r["host"] != "") | r["has_user"]
        same = ~own & (r["path"] == "") & ~r["has_query"]
        merged = (
            F.when(own, r["escaped_path"])
            .when(r["path"] == "", base["escaped_path"])
            .when(F.startswith(r["path"], F.lit("/")), r["escaped_path"])
            .otherwise(F.concat(F.regexp_extract(base["escaped_path"], "\\A(.*/)?", 0), r["escaped_path"]))
        )
        return F.struct(
            F.when(r["scheme"] != "", r["scheme"]).otherwise(base["scheme"]).alias("scheme"),
            F.when(own, r["user"]).otherwise(base["user"]).alias("user"),
            F.when(own, r["has_user"]).otherwise(base["has_user"]).alias("has_user"),
            F.when(own, r["host"]).otherwise(base["host"]).alias("host"),
            F.when(own, r["hostname"]).otherwise(base["hostname"]).alias("hostname"),
            F.when(own, r["port"]).otherwise(base["port"]).alias("port"),
            remove_dot_segments(merged).alias("escaped_path"),
            F.when(same, base["query"]).otherwise(r["query"]).alias("query"),
            F.when(same, base["has_query"] & (base["query"] != "")).otherwise(r["has_query"]).alias("has_query"),
            F.when(same & (r["fragment"] == ""), base["fragment"]).otherwise(r["fragment"]).alias("fragment"),
            (same & (r["fragment"] == "")).alias("same_page"),
        )

    parsed = F.filter(parse_all(references), lambda r: r["valid"])
    found = F.filter(F.transform(parsed, pick), lambda s: (s["scheme"] != "") & (s["host"] != ""))
    return F.transform(found, lambda s: _with(s, path=unescape_path(s["escaped_path"]), url=_text(s)))


def resolve(base_url: Column, reference: Column) -> Column:
    """Absolute URL of one reference, or null when it has none."""
    found = resolve_all(parse(base_url), F.array(reference))
    return F.get(found, F.lit(0))["url"]
