"""RE2-syntax patterns: rewrites, refusals, and agreement with an RE2 engine."""

import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievenet.functions.regex import RegexLoopError, RegexSyntaxError, to_spark_regex, wildcard
from sievenet.sources.patterns import packaged_patterns

CASES = [
    # pattern, line, matches
    ("y$", "y\r", []),
    ("y.", "y\r", ["y\r"]),
    (r"a\sb", "a\x0bb a b", ["a b"]),
    ("(?i)secret", "SECRET ſecret", ["SECRET", "ſecret"]),
    ("(?i)k", "kKK", ["k", "K", "K"]),
    ("(?i)i", "iIıİ", ["i", "I"]),
    ("(?P<n>x+)y", "xxy", ["xxy"]),
    ("[[:alpha:]]+", "ab1:c", ["ab", "c"]),
    ("[[:^digit:]]+", "1ab2", ["ab"]),
    ("[a&&b]+", "a&b", ["a&b"]),
    ("[[a]+", "[a", ["[a"]),
    (r"\bé", "éa é", []),
    (r"\bfoo\b", "foo éfoo foo_", ["foo", "foo"]),
    ("(?U)a+", "aaa", ["a", "a", "a"]),
    ("a{,2}", "a{,2} aa", ["a{,2}"]),
    (r"\Qa.b\E+", "a.bbb axb", ["a.bbb"]),
    (r"\x{1F600}|\x41", "😀A", ["😀", "A"]),
    (r"\v", "\x0b\n", ["\x0b"]),
    (r"\101", "A", ["A"]),
    ("a*", "baaac", ["", "aaa", ""]),
    ("a+|$", "baaac", ["aaa", ""]),
    ("b|a*?", "bab", ["b", "b"]),
    ("(?s).", "\r", ["\r"]),
    (r"[^\S\n]+", "a \t b", [" \t "]),
    (r"\p{Greek}+|\pN", "αβ1", ["αβ", "1"]),
    ("[a-c]+@[a-c]+", "xab@c@a", ["ab@c"]),
    ('"(?:/[^"{}]+)+":', '"/a/b":', ['"/a/b":']),
]


def test_cases(spark):
    rows = [(i, line, to_spark_regex(p).java) for i, (p, line, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "i int, line string, java string").select(
        "i", F.regexp_extract_all("line", F.col("java"), F.lit(0)).alias("found")
    )
    got = {r["i"]: r["found"] for r in frame.collect()}
    assert [(c[0], got[i]) for i, c in enumerate(CASES)] == [(c[0], c[2]) for c in CASES]


@pytest.mark.parametrize(
    "pattern",
    ["a**", "a++", "(?=x)", "(?<=x)", "(?!x)", r"(a)\1", "(?>x)", "[b-a]", r"\Z", r"\h", "x{2000}", "(", "a)", "*a", "[[:foo:]]", "[a", "{1}"],
)
def test_refused(pattern):
    with pytest.raises(RegexSyntaxError):
        to_spark_regex(pattern)


LOOPS = ["(?:ab|c)+x", "(?:[a-z]|-)+", "(?:ab|c)+", r"(?:\w+,?)+", r"(?:\w+,)+ ", "((?:ab|c)+)x", "(?:(?:ab|c)+;)+", "(?:ab|ac)+x", "(?:/[a-z]+)+[?]", "(?:ab|c){2,}", "(?:b|(?:ab|cc)+)d?", "(?:a|b|é)+c"]


def test_loops_on_long_lines(spark):
    """Groups repeat on long lines without recursion, and find what RE2 finds."""
    db = duckdb.connect()
    texts = ["abc" * 5_000 + "x", "ab-" * 9 + "abcabx ab,c,ab c;ab;x", "/ab/c/abc?/x" * 3_000, "acab" * 4_000 + "x", "aé" * 4_000 + "c", "ab,c," * 4_000 + " "]
    frame = spark.createDataFrame([(i, j, t, to_spark_regex(p).java) for i, p in enumerate(LOOPS) for j, t in enumerate(texts)], "i int, j int, t string, java string")
    for r in frame.select("i", "j", F.md5(F.to_json(F.regexp_extract_all("t", F.col("java"), F.lit(0)))).alias("m")).collect():
        want = db.execute("SELECT md5(CAST(to_json(regexp_extract_all(?, ?)) AS VARCHAR))", [texts[r.j], LOOPS[r.i]]).fetchall()[0][0]
        assert r.m == want, (LOOPS[r.i], r.j)
    line = spark.createDataFrame([("abc" * 350_000 + "x",)], "t string")
    assert line.select(F.length(F.regexp_extract_all("t", F.lit(to_spark_regex(LOOPS[0]).java), F.lit(0))[0])).first()[0] == 1_050_001


AMBIGUOUS = [
    r"(?:[a-z0-9-]+\.)+[a-z]{2,}", r"https?://(?:[\w-]+\.)+\w+", r"(?:\w+\.)*\w+@\w+", r"(\w+,)+x", "(?:[^,]+,)+end", "(a|ab)*c", r"(?:[0-9]+\.)+[0-9]+", r"(\w+\s?)+$",
    "(?:[A-Z][a-z]+ )+[A-Z]", "([a-z]+[0-9]*)+@", "a(?:b*|cb*)*", r"\b(?:\w+\.)+com\b", r"(?:[a-z]{1,63}\.)+[a-z]{2,63}", "(?:(?:ab|c)+)+a", "(?:ab|c)+?x", "(?:a+b?)+ax",
]


def test_ambiguous_loops(spark):
    """What an automaton rewrites finds what RE2 finds, on short lines and on long ones."""
    db = duckdb.connect()
    texts = ["a-.xa-cabcc- www.example.com, see http://a.b-c.org a.b@c x,x,end", "ab,x1,xx,y end The Cat Sat On 10.0.0.1 ab12c@ abcabac", "a.b-1.com" * 3_000, "ab c " * 5_000, "1.2." * 4_000 + "x", "Ab Cd " * 3_000 + "E", "ab," * 5_000 + "x,end", "abcc" * 5_000 + "x"]
    frame = spark.createDataFrame([(i, j, t, to_spark_regex(p).java) for i, p in enumerate(AMBIGUOUS) for j, t in enumerate(texts)], "i int, j int, t string, java string")
    for r in frame.select("i", "j", F.md5(F.to_json(F.regexp_extract_all("t", F.col("java"), F.lit(0)))).alias("m")).collect():
        want = db.execute("SELECT md5(CAST(to_json(regexp_extract_all(?, ?)) AS VARCHAR))", [texts[r.j], AMBIGUOUS[r.i]]).fetchall()[0][0]
        assert r.m == want, (AMBIGUOUS[r.i], r.j)


@pytest.mark.parametrize("pattern, text, size", [(AMBIGUOUS[0], "ab-1." * 200_000 + "com", 1_000_003), (AMBIGUOUS[7], "abcd " * 200_000, 1_000_000), (AMBIGUOUS[3], "ab,x," * 200_000 + "x", 1_000_001), (AMBIGUOUS[4], "ab,c," * 200_000 + "end", 1_000_003), (AMBIGUOUS[5], "aab" * 333_333 + "c", 1_000_000)])
def test_ambiguous_loops_on_a_megabyte(spark, pattern, text, size):
    line = spark.createDataFrame([(text,)], "t string")
    assert line.select(F.length(F.regexp_extract_all("t", F.lit(to_spark_regex(pattern).java), F.lit(0))[0])).first()[0] == size


@pytest.mark.parametrize("pattern", [r"(?:\p{Greek}+,)+x", r"(?:a\b|ab)+a"])
def test_loops_without_an_automaton_are_refused(pattern):
    with pytest.raises(RegexLoopError, match="repeats a group"):
        to_spark_regex(pattern)


def test_needed_literals():
    needs = {p.name: to_spark_regex(p.regex).needs for p in packaged_patterns()}
    assert needs["email"] == (frozenset({"@"}),)
    assert needs["JWT"] == (frozenset({"eyJ"}),)
    assert needs["Swagger/OpenAPI spec"][0] == frozenset({"swagger", "openapi"})
    assert needs["GraphQL endpoint"] == (frozenset({"graphql", "gql"}),)
    assert needs["API key-like string"] == ()
    assert to_spark_regex("a?b*").needs == ()


def test_wildcard():
    assert re.fullmatch(wildcard("a.*/x+").replace("\\z", "\\Z"), "a.b/c/x+")
    assert not re.fullmatch(wildcard("a.*").replace("\\z", "\\Z"), "ab")


PIECES = st.sampled_from(["a", "b", "ab", "[ab]", "[^a]", "a+", "[ab]+", "b*c", r"\w", r"\s", r"\d+", ".", "(?:ab|c)", "(?:ab)+", "(?:a[abc]+)+", "(?:ab|c)+", "(?:ab|[cé])*", "(?:a|1)+", "c?", "é", "(?i:ab)", "a{2,3}", "x|y", "(?:a*)*c", "(?:b*|cb*)*x", "(?:a|ab)+", "(?:[ab]+c)+[ab]", "(?:ab|a)*?c"])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(PIECES, min_size=1, max_size=4).map("".join), min_size=12, max_size=12),
    st.lists(st.text("abcAé 1\tx", min_size=0, max_size=14), min_size=12, max_size=12),
)
def test_same_matches_as_re2(spark, patterns, texts):
    """Non-empty patterns find what DuckDB's RE2 finds, guards included."""
    db = duckdb.connect()
    pairs = [(p, s) for p, s in zip(patterns, texts) if not re.search(p, "")]
    if not pairs:
        return
    rows = [(i, s, to_spark_regex(p).java) for i, (p, s) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "i int, s string, java string")
    got = {r["i"]: r["m"] for r in frame.select("i", F.regexp_extract_all("s", F.col("java"), F.lit(0)).alias("m")).collect()}
    for i, (p, s) in enumerate(pairs):
        want = db.execute("SELECT regexp_extract_all(?, ?)", [s, p]).fetchone()[0]
        assert got[i] == want, (p, s)
        for clause in to_spark_regex(p).needs:
            assert not want or any(word in s for word in clause), (p, s)


LEAVES = st.sampled_from(["a", "b", "[ab]", "[^a]", "ab", "é", r"\w", ",", "b*", "a?", "c+", "b+?", "a*?"])
TREES = st.recursive(
    LEAVES,
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=3).map("".join),
        st.lists(inner, min_size=1, max_size=3).map(lambda x: "(?:" + "|".join(x) + ")"),
        st.tuples(inner, st.sampled_from(["*", "+", "*?", "+?", "{2,}", "?", "{1,2}"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
    ),
    max_leaves=8,
)
ENDS = st.sampled_from(["", "", "$", r"\b"])


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(TREES, ENDS).map("".join), min_size=15, max_size=15), st.lists(st.text("abcé, x", max_size=20), min_size=15, max_size=15))
def test_generated_loops(spark, patterns, texts):
    """Loops over anything, empty or not, lazy or greedy, nested: the non-empty matches are RE2's."""
    db = duckdb.connect()
    rows = [(i, s, to_spark_regex(p).java) for i, p in enumerate(patterns) for s in texts]
    for r in spark.createDataFrame(rows, "i int, s string, java string").select("i", "s", F.regexp_extract_all("s", F.col("java"), F.lit(0)).alias("m")).collect():
        want = db.execute("SELECT regexp_extract_all(?, ?)", [r.s, patterns[r.i]]).fetchone()[0]
        assert [x for x in r.m if x] == [x for x in want if x], (patterns[r.i], r.s)


ENDED = [r"(\w+\s?)+$", r"(?:a+b?)+\b", r"(?:ab|a)+$", r"(?:a|ab?c?)+\B", r"(?:a+ ?)+\b", r"(?:b ?a*)+\b", r"(?:a b|a)+\b"]


def test_ended_loops_agree_with_backtracking(spark):
    from itertools import product

    texts = ["".join(chars) for size in range(1, 8) for chars in product("ab ", repeat=size)] + ["a, b c", "a\tb!\n", "é a", "ab cab c"]
    frame = spark.createDataFrame([(text,) for text in texts], "line string")
    java = [F.regexp_extract_all("line", F.lit(to_spark_regex(p).java), F.lit(0)) for p in ENDED]
    for row in frame.select("line", F.array(*java).alias("found")).collect():
        for pattern, found in zip(ENDED, row["found"]):
            plain = re.compile(pattern.replace("$", r"\Z"), re.ASCII)
            assert found == [m.group(0) for m in plain.finditer(row["line"])], (pattern, row["line"])


def test_ended_loops_run_once_over_a_long_line(spark):
    import time

    java = to_spark_regex(r"(\w+\s?)+$").java
    line = F.concat(F.expr("repeat('word ', 60000 + CAST(id AS INT))"), F.lit("!"))
    start = time.time()
    found = spark.range(1).select(F.size(F.regexp_extract_all(line, F.lit(java), F.lit(0))).alias("n")).first()["n"]
    assert found == 0 and time.time() - start < 15
