import gzip
import zlib

import pytest
from fixture_site import captures
from pyspark.sql import functions as F

from sievenet import Pattern, assemble, combine_requests, dedup_requests, find_by_names, latest_captures, load_patterns, normalize_captures, packaged_patterns
from sievenet import read_corpus, read_requests, read_saved_scans, scan, scan_saved, stream_captures, stream_findings, url_requests, write_corpus, write_findings, write_report
from sievenet.session import fits_broadcast, new_dir
from sievenet.sinks.corpus import manifest, manifest_lines, parse_save_dir, rows_to_save
from sievenet.session import write_counted
from sievenet.sinks.findings import CSV_OPTIONS, json_lines, resolve_kind

RAW = (
    b"http://a/1\r\n\r\n  http://a/2  \nPOST /home?x=1 HTTP/1.1\r\nHost: example.com\r\nuser-agent: UA\r\nCookie: a\r\ncookie: b\r\njunk\r\n\r\n"
    b"hello=world\r\nmore\r\n\r\nGET /x%20y HTTP/1.1\nHost: localhost:8080\n\n\nhttp://not/a/url\nget http://abs/x http/1.0\n"
)


@pytest.mark.parametrize("split", [None, 40])
def test_request_file(spark, tmp_path, split):
    (tmp_path / "r.txt").write_bytes(RAW)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        rows = read_requests(spark, str(tmp_path / "r.txt")).orderBy("req_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.method, r.url) for r in rows] == [
        ("GET", "http://a/1"),
        ("GET", "http://a/2"),
        ("POST", "https://example.com/home?x=1"),
        ("GET", "http://localhost:8080/x%2520y"),
        ("GET", "http://abs/x"),
    ]
    assert rows[2].headers == {"Host": ["example.com"], "User-Agent": ["UA"], "Cookie": ["a", "b"]}
    assert bytes(rows[2].body) == b"hello=world\nmore"
    assert bytes(rows[3].body) == b"\nhttp://not/a/url"
    assert rows[4].body is None and rows[0].headers is None


def test_request_without_host(spark, tmp_path):
    (tmp_path / "r.txt").write_text("GET /x HTTP/1.1\nA: b\n")
    assert read_requests(spark, str(tmp_path / "r.txt"), strict=False).first()["error"]
    with pytest.raises(Exception, match="without a Host header"):
        read_requests(spark, str(tmp_path / "r.txt")).collect()


def test_oversized_request(spark, tmp_path, monkeypatch):
    (tmp_path / "r.txt").write_text("http://a/\nGET /x HTTP/1.1\nHost: h\n\n" + "body\n" * 50 + "GET /y HTTP/1.1\nHost: h\n")
    monkeypatch.setattr("sievenet.sources.requests.MAX_BLOCK", 100)
    rows = read_requests(spark, str(tmp_path / "r.txt"), strict=False).orderBy("req_ord").collect()
    assert [(r.url, r.error is None) for r in rows] == [("http://a/", True), (None, False), ("https://h/y", True)]


def test_several_request_files(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.txt").write_text(f"http://{name}/1\nhttp://same/\n")
    rows = read_requests(spark, str(tmp_path))
    assert [(r.req_ord, r.url) for r in rows.orderBy("req_ord").collect()] == [(1, "http://a/1"), (2, "http://same/"), (3, "http://b/1"), (4, "http://same/"), (5, "http://c/1"), (6, "http://same/")]
    assert [r.req_ord for r in dedup_requests(rows).where("url = 'http://same/'").collect()] == [2]


def test_dedup_and_order_of_sources(spark):
    one = url_requests(spark.createDataFrame([(1, "http://a"), (2, " "), (3, "http://b")], "req_ord bigint, url string"))
    two = url_requests(spark.createDataFrame([(1, "http://b"), (2, "http://c")], "req_ord bigint, url string"))
    rows = dedup_requests(combine_requests(one, two)).orderBy("req_ord").collect()
    assert [r.url for r in rows] == ["http://a", "http://b", "http://c"]
    headed = one.withColumn("headers", F.expr("map('A', IF(req_ord = 1, array('1','2'), array('2','1')))")).withColumn("url", F.lit("u"))
    assert dedup_requests(headed).count() == 1


def test_encoded_bodies(spark):
    packed = gzip.compress(b"needle")
    rows = [
        (1, " GZIP ", packed, "text/html; charset=x"), (2, "deflate", zlib.compress(b"d"), " a "), (3, "", b"plain", None),
        (4, "gzip", b"bad", ""), (5, "br", b"br", ""), (6, "x-gzip", packed + packed, ""),
        (7, "gzip", gzip.compress(b"a" * 9_000_000), ""), (8, "gzip", packed[:-4], ""), (9, "identity", b"b" * 9_000_000, ""),
    ]
    frame = spark.createDataFrame([(i, "u", e, bytearray(b), t) for i, e, b, t in rows], "capture_id bigint, url string, content_encoding string, body binary, content_type string")
    got = {r.capture_id: (r.content_type, r.n, r.head) for r in normalize_captures(frame).select("capture_id", "content_type", F.length("body").alias("n"), F.expr("left(CAST(body AS STRING), 12)").alias("head")).collect()}
    assert got == {
        1: ("text/html", 6, "needle"), 2: ("a", 1, "d"), 3: ("", 5, "plain"), 5: ("", 2, "br"),
        6: ("", 12, "needleneedle"), 7: ("", 9_000_000, "a" * 12), 9: ("", 9_000_000, "b" * 12),
    }
    cut = {r.capture_id: (r.n, r.truncated) for r in normalize_captures(frame, 6).select("capture_id", "truncated", F.length("body").alias("n")).collect()}
    assert cut == {1: (6, False), 2: (1, False), 3: (5, False), 5: (2, False), 6: (6, True), 7: (6, True), 9: (6, True)}
    whole = normalize_captures(frame, keep_undecoded=True)
    assert sorted(r.capture_id for r in whole.where("body IS NULL").collect()) == [4, 8]


def test_keys_need_no_bodies(spark, tmp_path):
    """Selecting keys neither reads nor decodes bodies."""
    raw = spark.createDataFrame([("u", "gzip", bytearray(b"bad"))], "url string, content_encoding string, body binary")
    raw.write.parquet(str(tmp_path / "raw"))
    keys = normalize_captures(spark.read.parquet(str(tmp_path / "raw")), keep_undecoded=True).select("method", "url")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "Arrow" not in plan and keys.count() == 1
    every = normalize_captures(spark.read.parquet(str(tmp_path / "raw")))
    assert every._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_latest_captures(spark):
    frame = spark.createDataFrame([(1, "GET", "u#a", 5), (2, "GET", "u", 7), (3, "GET", "u", 7), (4, "POST", "u", 1)], "capture_id bigint, method string, url string, at int")
    assert sorted(r.capture_id for r in latest_captures(frame, "at").collect()) == [3, 4]


def test_pattern_files(spark, tmp_path):
    good, bad = tmp_path / "good.txt", tmp_path / "bad.txt"
    good.write_text("# c\n\ncustom || custom-regex || more\nx||a\nx||b\n")
    bad.write_text("name only\n")
    loaded = load_patterns(spark, [str(tmp_path / "none.txt"), str(bad), str(good)])
    assert [(p.name, p.regex) for p in loaded] == [("custom", "custom-regex || more"), ("x", "a"), ("x", "b")]
    assert loaded[0].source == f"builtin:{good}:custom"
    assert [p.regex for p in find_by_names(loaded, ["x", "nope", "custom"])] == ["b", "custom-regex || more"]
    assert [p.source for p in load_patterns(spark)][:1] == ["builtin:embedded:JWT"] and len(packaged_patterns()) == 9
    with pytest.raises(ValueError):
        assemble()
    twice = assemble([Pattern("n", "r", "s")], ["r", "r"])
    assert [(p.name, p.regex) for p in twice] == [("n", "r"), ("custom", "r")]


def save(folder, index=None, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    if index is not None:
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "index.txt").write_text(index)


def test_saved_scan_with_manifest(spark, tmp_path):
    save(tmp_path, "000001\t404\ttext/html\thttps://example.com/index.html\tex/index.html\n\n", ex__index_dot_html="needle", stray="needle")
    rows = read_saved_scans(spark, str(tmp_path)).collect()
    assert [(r.final_url, r.status, r.content_type, bytes(r.body), r.queue_ord) for r in rows] == [("https://example.com/index.html", 404, "text/html", b"needle", 1)]


@pytest.mark.parametrize("index", ["1\t200\ta\tb\n", "1\tx\ta\tu\tex/index.html\n", "1\t200\ta\tu\tmissing\n"])
def test_unusable_manifest(spark, tmp_path, index):
    save(tmp_path, index, ex__index_dot_html="needle", b="x")
    rows = {r.final_url: (r.status, r.content_type) for r in read_saved_scans(spark, str(tmp_path)).collect()}
    assert rows == {"file://ex/index.html": (200, "text/html"), "file://b": (200, "application/octet-stream")}


def test_long_manifest_line(spark, tmp_path):
    save(tmp_path, "1\t200\t" + "a" * 70000 + "\tu\tex/index.html\n", ex__index_dot_html="needle")
    assert [(r.final_url, len(r.content_type)) for r in read_saved_scans(spark, str(tmp_path)).collect()] == [("u", 70000)]


def test_saved_scans_below_a_root(spark, tmp_path):
    save(tmp_path / "one", None, example__a_dot_js="needle")
    save(tmp_path / "two" / "deep", "1\t200\ttext/html\thttps://h/\tx.html\n", x_dot_html="needle")
    save(tmp_path / "empty", "")
    found = scan_saved(spark, str(tmp_path), assemble(custom=["needle"]), discover=True, keep=["scan_dir"]).collect()
    assert sorted((r.scan_dir, r.resource_url) for r in found) == [("one", "file://example/a.js"), ("two", "file://deep/x.html"), ("two/deep", "https://h/")]
    single = read_saved_scans(spark, str(tmp_path))
    assert sorted(r.final_url for r in single.collect()) == ["file://one/example/a.js", "file://two/deep/x.html"]
    with pytest.raises(ValueError):
        (tmp_path / "void").mkdir()
        read_saved_scans(spark, str(tmp_path / "void"))


def test_corpus_roundtrip_and_collisions(spark):
    pages = [("https://h/a", "text/html", "first"), ("https://h/a/", "text/html", "second"), ("https://h/b?x", "text/html", "third")]
    out = new_dir(spark, "corpus")
    write_corpus(captures(spark, pages), out, mode="full", order="capture_id")
    rows = sorted((r.queue_ord, r.final_url, bytes(r.body)) for r in read_corpus(spark, out).collect())
    assert rows == [(1, "https://h/a", b"second"), (2, "https://h/a/", b"second"), (3, "https://h/b?x", b"third")]
    lines = manifest_lines(manifest(captures(spark, pages), "capture_id")).orderBy("ord").collect()
    assert lines[0].value == "000001\t200\ttext/html\thttps://h/a\th/a.html"
    large = manifest(captures(spark, pages).withColumn("capture_id", F.col("capture_id") + (1 << 40)), "capture_id")
    assert manifest_lines(large).agg(F.min("value")).first()[0].startswith(f"{(1 << 40) + 1}\t200")


def test_corpus_moves_bodies_once(spark, tmp_path):
    """Rows that share a path are found on narrow columns; ties of the order keep one row each."""
    frame = captures(spark, [("https://h/a", "text/html", "1"), ("https://h/a/", "text/html", "2"), ("https://h/c", "text/html", "3")]).withColumn("at", F.lit(7))
    out = new_dir(spark, "corpus")
    write_corpus(frame, out, mode="full", order="at")
    assert sorted((r.final_url, bytes(r.body)) for r in read_corpus(spark, out).collect()) == [("https://h/a", b"2"), ("https://h/a/", b"2"), ("https://h/c", b"3")]


def test_save_modes(spark):
    frame = spark.createDataFrame([("https://app.example.com/a",), ("https://example.com/",)], "final_url string").withColumn("target_url", F.lit("*.example.com/*"))
    assert [r.final_url for r in rows_to_save(frame, "scope").collect()] == ["https://app.example.com/a"]
    assert rows_to_save(frame, "full").count() == 2 and rows_to_save(frame, "other").count() == 0
    assert parse_save_dir("Full: /x ") == ("full", "/x") and parse_save_dir("s3://b/x") == ("scope", "s3://b/x") and parse_save_dir(" ") == ("", "")
    with pytest.raises(ValueError):
        parse_save_dir("scope:")


def test_sinks(spark):
    frame = spark.createDataFrame([(1, ' a,"b" ', "<&>"), (2, "", "x\\y")], "line int, matched_value string, context string")
    out = new_dir(spark, "f") + ".csv"
    write_findings(frame, out)
    back = spark.read.options(**CSV_OPTIONS).schema("line string, matched_value string, context string").csv(out)
    assert sorted(map(tuple, back.fillna("").collect())) == [("1", ' a,"b" ', "<&>"), ("2", "", "x\\y")]
    assert sorted(r.value for r in json_lines(frame).collect())[0] == '{"context":"\\u003c\\u0026\\u003e","line":"1","matched_value":" a,\\"b\\" "}'
    assert [resolve_kind(k) for k in ("json", "x/y.CSV", "out.txt", "a.b/c", "")] == ["json", "csv", "plain", "plain", "plain"]


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame([(f"https://h/{i}", "text/html", f"needle{i}\nx\nneedle") for i in range(20)], "url string, content_type string, body string")
    source = str(tmp_path / "in")
    pages.repartition(4).write.parquet(source)
    patterns = assemble(custom=["needle[0-9]*"])
    streamed = scan(stream_captures(spark, source, pages.schema, maxFilesPerTrigger=1), patterns)
    stream_findings(streamed, str(tmp_path / "out"), str(tmp_path / "state"), "parquet").awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), scan(normalize_captures(pages), patterns)
    assert got.count() == 40 and got.exceptAll(want).count() == 0


def test_broadcast_size_check():
    assert fits_broadcast(1 << 20) and not fits_broadcast(1 << 30)


def test_restart_between_commit_and_checkpoint(spark, tmp_path):
    """A batch whose findings were committed, but not its progress, is not written twice."""
    pages = spark.createDataFrame([(f"https://s.test/{i}", "text/plain", bytearray(b"needle needles")) for i in range(4)], "url string, content_type string, body binary")
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    pages.repartition(2).write.parquet(source)
    for kind in ("csv", "json", "plain"):

        def run(kind=kind):
            found = scan(stream_captures(spark, source, pages.schema, maxFilesPerTrigger=1), assemble(custom=["needles?"]), fields=["resource_url", "matched_value"])
            stream_findings(found, f"{out}/{kind}", f"{state}/{kind}", kind).awaitTermination()
            reader = spark.read.options(**CSV_OPTIONS) if kind == "csv" else spark.read
            return sorted(map(str, (reader.csv(f"{out}/{kind}") if kind == "csv" else reader.text(f"{out}/{kind}")).collect()))

        first = run()
        commits = tmp_path / "state" / kind / "commits"
        last = max((f for f in commits.iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
        last.unlink()
        (commits / f".{last.name}.crc").unlink(missing_ok=True)
        assert run() == first and len(first) == 8


def test_report_parts_are_in_order(spark, tmp_path, request):
    """One resource with most of the findings, ties, and a lead other than the resource."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts, however small
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = [("u1", 1 + i % 7, f"v{i % 90:02}", 0, i, 2) for i in range(3000)] + [("u0", 1, "w", 1, 0, 9), ("u0", 1, "w", 0, 0, 9)]
    found = spark.createDataFrame(rows, "resource_url string, line int, matched_value string, pattern_ord int, match_ord int, queue_ord int").repartition(6)
    for lead in ("resource_url", "queue_ord"):
        write_report(found, str(tmp_path / lead), "plain", [lead], ["resource_url", "line", "matched_value"])
        parts = sorted((tmp_path / lead).glob("part-*"))
        written = [line for part in parts for line in part.read_text().splitlines()]
        at = 0 if lead == "resource_url" else 5
        assert len(parts) > 1 and written == ["\t".join(map(str, r[:3])) for r in sorted(rows, key=lambda r: (r[at], *r[1:5]))]


def test_measured_sizes(spark, tmp_path):
    """Sizes come from lengths: a body of a megabyte counts as one."""
    rows = spark.createDataFrame([("u", {"A": ["b", "c"]}, bytearray(1 << 20), None), (None, None, None, [1])], "url string, headers map<string,array<string>>, body binary, x array<int>")
    _, size = write_counted(rows, str(tmp_path / "t"))
    assert size.rows == 2 and 0 <= size.bytes - (1 << 20) < 400
