import pytest
from fixture_site import HOST, PAGES, captures
from pyspark.sql import functions as F

from sievenet import Pattern, assemble, find_by_names, packaged_patterns, parse_fields, scan, top_findings
from sievenet.operators.scan import lines
from sievenet.schemas import FINDING_FIELDS
from sievenet.sources.captures import normalize_captures


def values(frame):
    return [tuple(r) for r in frame.collect()]


def body(spark, text, kind="text/plain", url="https://s.test/x"):
    data = text if isinstance(text, bytes) else text.encode()
    return normalize_captures(spark.createDataFrame([(1, url, kind, bytearray(data))], "capture_id bigint, url string, content_type string, body binary"))


def test_lines_keep_empty_tail_and_carriage_returns(spark):
    assert values(lines(body(spark, "a\r\n\nb\n")).orderBy("line")) == [(1, "a\r"), (2, ""), (3, "b"), (4, "")]


def test_dedup_is_per_line_and_regex(spark):
    dup = body(spark, PAGES[0][2])
    two = assemble(custom=["ticket", "tick[a-z]+"])
    assert scan(dup, two[:1]).count() == 1
    assert scan(dup, two[:1], dedup=False).count() == 3
    assert scan(dup, two).count() == 2
    named = [Pattern("first", "ticket", "s1"), Pattern("second", "ticket", "s2")]
    assert values(scan(dup, named, fields=["pattern_name"])) == [("first",)]
    assert scan(dup, named, dedup=False).count() == 6


def test_without_dedup_is_a_superset(spark):
    caps = captures(spark)
    patterns = assemble(packaged_patterns(), ["[a-z]+"])
    fields = ["pattern", "matched_value", "resource_url", "line"]
    fewer, more = scan(caps, patterns, fields=fields), scan(caps, patterns, fields=fields, dedup=False)
    assert fewer.exceptAll(more).count() == 0
    assert fewer.subtract(more.distinct()).count() == 0


def test_matches_do_not_cross_lines(spark):
    assert values(scan(body(spark, "ab\nab"), assemble(custom=[r"b\sa"]))) == []


def test_empty_matches(spark):
    found = scan(body(spark, "baaac"), assemble(custom=["a*"]), dedup=False, fields=["matched_value", "context"], keep=["match_ord"])
    assert values(found.orderBy("match_ord")) == [("", "baaac", 0), ("aaa", "baaac", 1), ("", "baaac", 2)]


def test_context_window_in_bytes(spark):
    text = "é" * 60 + "needle" + "x" * 100
    got = values(scan(body(spark, text), assemble(custom=["needle"]), fields=["context"]))
    assert got == [("..." + "é" * 40 + "needle" + "x" * 80 + "...",)]
    text = "é" * 60 + "aneedle  "
    got = values(scan(body(spark, text), assemble(custom=["needle"]), fields=["context"]))
    assert got == [("...�" + "é" * 39 + "aneedle",)]
    twice = "one " + "y" * 200 + " one!"
    got = values(scan(body(spark, twice), assemble(custom=["one!?$"]), fields=["matched_value", "context"]))
    assert got == [("one!", "..." + "y" * 79 + " one!")]


def test_invalid_bytes_are_replaced(spark):
    assert values(scan(body(spark, b"\xff\xfekey\xe2\x82"), assemble(custom=[".+"]), fields=["matched_value"])) == [("��key�",)]


def test_fields(spark):
    assert parse_fields(" line, ,status,line") == ["line", "status", "line"]
    for bad in ("", " , ", "line,nope"):
        with pytest.raises(ValueError):
            parse_fields(bad)
    repeated = scan(body(spark, "x"), assemble(custom=["x"]), fields=["line", "line"])
    assert repeated.columns == ["line", "line"]
    with pytest.raises(ValueError):
        scan(body(spark, "x"), [])


def test_report_order(spark):
    caps = captures(spark)
    top = top_findings(scan(caps, assemble(custom=["[a-z]+"]), fields=["resource_url", "line", "matched_value"], keep=["pattern_ord", "match_ord"]), 40)
    rows = [(r.resource_url, r.line, r.matched_value) for r in top.collect()]
    assert rows == sorted(rows) and len(rows) == 40


def test_fixture_site_patterns(spark):
    index = captures(spark).where(F.col("url") == HOST + "/")
    email = find_by_names(packaged_patterns(), ["email"])
    assert values(scan(index, email, fields=["matched_value", "line", "resource_kind"])) == [("desk@ferry.test", 3, "html"), ("quay@ferry.test", 3, "html")]


def test_scan_is_one_narrow_stage(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        F.col("source").alias("final_url"), F.lit("").alias("target_url"), F.lit("").alias("parent_url"),
        F.lit(200).alias("status"), F.col("lang").alias("content_type"), F.col("text").alias("body"), "n_chars",
    )
    plan = scan(frame, packaged_patterns(), fields=FINDING_FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Filter (size(" not in plan
    plan = scan(frame, packaged_patterns())._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,source:string>" in plan
    email = scan(frame, find_by_names(packaged_patterns(), ["email"]))._jdf.queryExecution().executedPlan().toString()
    assert "Contains" in email.split("Generate")[-1], "bodies without the needed literal are dropped before splitting"


def test_long_lines_stay_linear(spark):
    """Bodies that make naive backtracking quadratic or worse."""
    path = '"' + "/a" * 50_000
    bodies = [path + 'x ZZ":{', "A" * 2_000_000 + " @", "/" * 20_000 + "openapi.json", "api_key=" * 20_000]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string").selectExpr(
        "body", "'u' AS final_url", "'' AS target_url", "'' AS parent_url", "200 AS status", "'' AS content_type"
    )
    assert scan(frame, packaged_patterns()).count() == 1


def test_pages_listed(spark):
    assert captures(spark).count() == len(PAGES)
