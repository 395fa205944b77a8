import pytest
from fixture_site import captures
from pyspark.sql import functions as F

from sievenet import extract_links, parse_target, url_in_scope
from sievenet.functions import urls
from sievenet.functions.html import decode_entities, html_links
from sievenet.functions.paths import with_relative_path
from sievenet.operators.outscope import out_of_scope
from sievenet.operators.scope import literal_scope

BASE = "http://a/b/c/d;p?q"
RESOLVED = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    ";x": "http://a/b/c/;x", "g;x?y#s": "http://a/b/c/g;x?y#s", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/../y": "http://a/b/c/y", "#": BASE, "//": BASE, "/für": "http://a/f%C3%BCr", "/a b%41": "http://a/a%20bA",
    "/a'(b)%41": "http://a/a'(b)%41", "HTTPS://H:80/p": "https://H:80/p", "http://u:p@h/x": "http://u:p@h/x",
    "http://für.de/ü?ü#ü": "http://f%C3%BCr.de/%C3%BC?ü#%C3%BC", "x?": "http://a/b/c/x?", "/a:b": "http://a/a:b",
    "//a//b/../c": "http://a//c", " x": "http://a/b/c/%20x", "http://h/a/../../b": "http://h/b", "http://[::1]:8/x": "http://[::1]:8/x",
    "g:h": None, "/%zz": None, "mailto:x@y": None, "http://h:8x/": None, "a:b": None, "http://h b/": None, "a\tb": None,
    "http:///x": None, "javascript:void(0)": None, ":x": None,
}


def test_resolution(spark):
    frame = spark.createDataFrame([(BASE, r) for r in RESOLVED], "base string, ref string").repartition(2)
    got = {r[0]: r[1] for r in frame.select("ref", urls.resolve(F.col("base"), F.col("ref"))).collect()}
    assert got == RESOLVED


def test_html_tokenizer(spark):
    page = (
        '<!doctype html><!-- <a href="/no"> --><title><a href=/no2></title><script src=/s1.js?a=1&amp;b=2>var x="<a href=\'/no3\'>"</script>'
        "<LINK rel=x HREF = '/l1'><a title=\"<a href=/no4>\" href=/a1 href=/dup><a href><noscript><a href=/no5></noscript>"
        "<svg><a href='/ü'/></svg></div title=\"<a href=/no6>\"><script>1</script><script src=\"/s2.js\"></script>"
        '<a b=">" href="/z"><a =href=/no7 hrefx=/no8 href=/y><a "href=/w"><a href="/eof'
    )
    frame = spark.createDataFrame([(page,)], "b string").repartition(2)
    assert frame.select(html_links(F.col("b"))).first()[0] == ["/s1.js?a=1&b=2", "/s2.js", "/l1", "/a1", "", "/ü", "/z", "/y"]


def test_entities(spark):
    cases = {"&lt;x&#x41;&#128;": "<xA€", "&copy=1&copy;": "&copy=1©", "&notit;&not": "&notit;¬", "&#0;&#xD800;&#99999999999;": "�" * 3, "&#xZ;&;": "&#xZ;&;", "a&b": "a&b", "&#1114112;": "�", "&#128512;": "😀"}
    frame = spark.createDataFrame([(c,) for c in cases], "t string").repartition(2)
    assert {r[0]: r[1] for r in frame.select("t", decode_entities(F.col("t"))).collect()} == cases


SCOPES = [
    ("https://shelf.test/list", "https://shelf.test/list", True),
    ("https://shelf.test/list", "http://shelf.test/list", False),
    ("http://10.1.2.3:9090/list", "http://10.1.2.3:9090/list", True),
    ("http://10.1.2.3:9090/list", "http://10.1.2.3/list", False),
    ("*.orchard.test", "https://pear.orchard.test/", True),
    ("*.orchard.test", "http://plum.orchard.test/x", True),
    ("*.orchard.test", "https://orchard.test/", False),
    ("*.orchard.test", "https://a.b.orchard.test/", False),
    ("*.orchard.test", "https://pear.orchard.example/", False),
    ("*.orchard.test", "mailto:keeper@orchard.test", False),
    ("https://*.orchard.test/crates/*", "https://pear.orchard.test/crates/a/b", True),
    ("https://*.orchard.test/crates/*", "https://pear.orchard.test/barrels/a", False),
    ("eu.*.orchard.test", "https://eu.plum.orchard.test/", True),
    ("eu.*.orchard.test", "https://plum.orchard.test/", False),
    ("eu.*.orchard.test", "https://eu.a.b.orchard.test/", False),
    ("h/a.b", "http://h/axb", False),
    ("h/a.b", "http://h/a.b", True),
    ("h/a.b?x", "http://h/a.b?x", False),
    ("HTTP://H", "http://h", True),
    ("h", "http://h:80/", False),
    ("*", "http://h:80/", True),
    ("api*.h.com", "http://api1.h.com/", False),
    ("h/ü", "http://h/ü", False),
]


def test_scopes(spark):
    frame = spark.createDataFrame(SCOPES, "target string, url string, want boolean").repartition(2)
    got = frame.withColumn("got", url_in_scope(parse_target(F.col("target")), F.col("url"))).where("NOT (got <=> want)")
    assert got.collect() == []
    one = frame.where(F.col("target") == "*.orchard.test").withColumn("got", url_in_scope(literal_scope(spark, "*.orchard.test"), F.col("url")))
    assert one.where("NOT (got <=> want)").collect() == []


def test_targets(spark):
    seeds = {
        "https://shelf.test/list": ["https://shelf.test/list"],
        "*.orchard.test": ["https://orchard.test/", "http://orchard.test/"],
        "https://*.orchard.test/crates/*": ["https://orchard.test/crates/"],
        "a.*": ["https://a.*/", "http://a.*/"],
        "H:8080": ["https://h:8080/", "http://h:8080/"],
        "[::1]:80/x": ["https://[::1]:80/x", "http://[::1]:80/x"],
    }
    errors = ["", "https://", "/x", "https:///x", "a..b", ".a"]
    frame = spark.createDataFrame([(t,) for t in [*seeds, *errors]], "t string").select("t", parse_target(F.col("t")).alias("s"))
    rows = {r["t"]: r["s"] for r in frame.collect()}
    assert {t: rows[t]["seeds"] for t in seeds} == seeds
    assert all(rows[t]["error"] is None for t in seeds) and all(rows[t]["error"] for t in errors)
    with pytest.raises(ValueError):
        literal_scope(spark, "a..b")


def test_out_of_scope(spark):
    rules = ["images", "css", "video", "*.svg.*.img", " "]
    want = {"https://example.com/a.png": True, "https://example.com/a.css": True, "https://example.com/a.mp4": True, "https://example.com/a.html": False, "https://cdn.example.com/icon.svg.large.IMG": True}
    frame = spark.createDataFrame([(u,) for u in want], "u string")
    path = F.regexp_extract("u", "//[^/]*([^?#]*)", 1)
    assert {r[0]: r[1] for r in frame.select("u", out_of_scope(rules, F.col("u"), path)).collect()} == want
    assert not any(r[0] for r in frame.select(out_of_scope(["image"], F.col("u"), path)).collect())


def test_links_of_one_page(spark):
    body = (
        '<script src="b.js"></script><a href="/x&amp;y.json">1</a><a href="/capital#a">2</a><a href="/z.PNG">3</a><a href="page.php">4</a>'
        "<script>var u = '/x&amp;y.json'; s = \"./b.js\"; url='http://other.test/api';</script>"
    )
    caps = captures(spark, [("https://h.test/dir/p.html?q#f", "text/html", body)])
    links = [r["url"] for r in extract_links(caps).orderBy("link_ord").collect()]
    assert links == ["https://h.test/dir/b.js", "https://h.test/x&y.json", "https://h.test/capital#a", "http://other.test/api", "https://h.test/x&amp;y.json"]
    scoped = [r["url"] for r in extract_links(caps, "h.test/dir/*").orderBy("link_ord").collect()]
    assert scoped == ["https://h.test/dir/b.js", "https://h.test/dir/page.php"]
    plain = captures(spark, [("https://h.test/a.bin", "application/octet-stream", body)])
    assert extract_links(plain).count() == 0


def test_links_do_not_shuffle(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr(
        "page_id AS capture_id", "url AS final_url", "'text/html' AS content_type", "html AS body"
    )
    plan = extract_links(frame, "*.*.example.com")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("sourceMappingURL") <= 4, "candidates are computed once"


def test_relative_paths(spark):
    long = "a" * 240
    cases = {
        ("https://shelf.test/js/menu.js?rev=7", "x"): "shelf.test/js/menu__98363041.js",
        ("https://e.com", "text/html"): "e.com/index.",
        ("https://e.com/", "text/html"): "e.com/index.html",
        ("https://e.com/foo/", "text/html"): "e.com/foo.html",
        ("https://e.com:80/a/../b//c.d?x=1#f", "text/css"): "e.com_80/b/c__7caf6056.d",
        ("https://e.com/.htaccess", "text/css"): "e.com/htaccess.htaccess",
        ("https://e.com/?a=1", "text/html"): "e.com/index.html",
        ("https://e.com/a:b&c=d*/x", "application/json"): "e.com/a_b_c_d_/x.json",
        ("https://e.com/../../x", ""): "e.com/x.bin",
    }
    frame = spark.createDataFrame(list(cases), "final_url string, content_type string")
    assert {(r[0], r[1]): r[2] for r in with_relative_path(frame).collect()} == cases
    one = spark.createDataFrame([(f"https://example.com/{long}/offer.php", "")], "final_url string, content_type string")
    part = with_relative_path(one).first()["relative_path"].split("/")[1]
    assert len(part) == 96 and part.startswith("a" * 86 + "__")
