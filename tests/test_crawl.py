import pytest

from fixture_site import HOST, OTHER, QUEUE, captures
from pyspark.sql import functions as F
from sievenet import assemble, crawl, scan, scan_requests, scan_url, url_requests
from sievenet.operators import crawl as crawl_module
from sievenet.operators.scope import build_frontier
from sievenet.sources.requests import inherited_headers


def frontier(spark, *urls, scope=None):
    rows = spark.createDataFrame(list(enumerate(urls, 1)), "req_ord bigint, url string")
    return build_frontier(url_requests(rows), scope)


def paths(queue):
    return [r["url"].removeprefix(HOST) for r in queue.orderBy("queue_ord").collect()]


def test_queue_order_and_lineage(spark):
    got = crawl(captures(spark), frontier(spark, HOST), discover=True)
    assert paths(got.queue) == QUEUE
    rows = {r["url"].removeprefix(HOST): r for r in got.queue.collect()}
    assert rows["/"]["discovered_from"] == ""
    assert rows["/quays/api-list.txt"]["discovered_from"] == HOST + "/feeds/today.xml"
    assert rows["/graphql/boats"]["discovered_from"] == HOST + "/feeds/lines/north.json"
    assert {r["target_url"] for r in rows.values()} == {HOST}
    assert sorted(r["queue_ord"] for r in rows.values()) == list(range(1, 11))
    assert sorted(paths(got.unreachable)) == ["/graphql/boats", "/quays/lists/quays.map", "/services/api/tides?station=4"]
    assert got.resources.count() == 7


@pytest.mark.parametrize("cap", [1, 2, 3, 5])
def test_cap_keeps_queue_prefix(spark, cap):
    got = crawl(captures(spark), frontier(spark, HOST), discover=True, max_crawl=cap)
    assert paths(got.queue) == QUEUE[:cap]


def test_large_waves_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(crawl_module, "ONE_TASK_ROWS", 1)
    got = crawl(captures(spark), frontier(spark, HOST), discover=True)
    assert paths(got.queue) == QUEUE


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(crawl_module, "fits_broadcast", lambda measured: False)
    got = crawl(captures(spark), frontier(spark, HOST), discover=True)
    assert paths(got.queue) == QUEUE


def test_bucketed_edges(spark, monkeypatch):
    monkeypatch.setattr(crawl_module, "BUCKET_EDGES", 2)
    got = crawl(captures(spark), frontier(spark, HOST), discover=True)
    assert paths(got.queue) == QUEUE


@pytest.mark.parametrize("cap", [None, 1, 7])
def test_nothing_to_follow(spark, cap):
    """A crawl that finds no link, or no capture at all, just ends."""
    alone = captures(spark, [("https://a.test/", "text/html", "no links")])
    for target, reached in (("https://a.test/*", 1), ("https://b.test/*", 0)):
        got = crawl(alone, frontier(spark, target), max_crawl=cap)
        assert (got.queue.count(), got.resources.count(), got.capped) == (1, reached, False)


def test_cap_is_reported(spark):
    assert [crawl(captures(spark), frontier(spark, HOST), discover=True, max_crawl=n).capped for n in (3, 9, 10, 11)] == [True, True, False, False]


def test_latest_of_repeated_captures(spark):
    pages = [("https://s.test/", "text/html", "old needle"), ("https://s.test/#x", "text/html", "new needle needle")]
    run = scan_url(captures(spark, pages), "https://s.test/", assemble(custom=["[a-z]+ needle"]))
    assert [r["matched_value"] for r in run.findings.collect()] == ["new needle"]


def test_many_seeds_and_scopes_prune_pages(spark):
    """Only pages in a scope, and seeds, have their links extracted, however many seeds there are."""
    pages = [(f"https://h{i}.s.test/p{k}", "text/html", "<a href='/api'>x</a>") for i in range(50) for k in range(2)]
    caps = captures(spark, pages)
    one = frontier(spark, *(f"https://h{i}.s.test/p0" for i in range(40)), scope="https://h1.s.test/*")
    kept = crawl_module._reachable_pages(caps, one, False)
    assert kept.count() == 41
    many = frontier(spark, *(f"*.h{i}.s.test/*" for i in range(3)), "h5.s.test/p1", "https://h6.s.test/*")
    assert sorted(r["url"] for r in crawl_module._reachable_pages(caps, many, False).collect()) == ["https://h5.s.test/p1", "https://h6.s.test/p0", "https://h6.s.test/p1"]
    wide = frontier(spark, "*.s.test/p1", "h7.s.test/p0")
    assert crawl_module._reachable_pages(caps, wide, False).count() == 51


def test_orders_may_be_any_bigint(spark):
    rows = spark.createDataFrame([((1 << 63) - 1, "b.test"), (-(1 << 63), "a.test")], "req_ord bigint, url string")
    got = crawl(captures(spark, [("https://a.test/", "text/html", "x")]), build_frontier(url_requests(rows)))
    assert paths(got.queue) == ["https://a.test/", "http://a.test/", "https://b.test/", "http://b.test/"]


def test_off_domain(spark):
    got = crawl(captures(spark), frontier(spark, HOST), discover=True, allow_off_domain=True)
    listed = paths(got.queue)
    assert listed[4:7] == ["/feeds/lines/north.json", OTHER + "/api/deep.json", "/quays/api-list.txt"]
    assert [u for u in listed if not u.startswith(OTHER)] == QUEUE
    assert OTHER + "/api/deeper.json" in paths(got.unreachable)


def test_discovery_needs_flag_or_wildcard(spark):
    pages = [
        ("https://s.test/shop/", "text/html", '<a href="/shop/api-item">x</a>'),
        ("https://s.test/shop/api-item", "text/html", "needle"),
        ("https://s.test/shop/logo.png", "image/png", "needle"),
    ]
    caps = captures(spark, pages)
    assert crawl(caps, frontier(spark, "https://s.test/shop/")).queue.count() == 1
    assert paths(crawl(caps, frontier(spark, "https://s.test/shop/*")).queue) == ["https://s.test/shop/", "https://s.test/shop/api-item"]


def test_wildcard_follows_what_a_literal_scope_ignores(spark):
    pages = [
        ("https://s.test/shop/", "text/html", '<a href="pages/offer.php"></a><a href="/shop/logo.png"></a><script src="menu.js"></script>'),
        ("https://s.test/shop/pages/offer.php", "text/html", "needle"),
    ]
    run = scan_url(captures(spark, pages), "https://s.test/shop/*", assemble(custom=["needle"]), out_scope=["images"])
    assert [r["resource_url"] for r in run.findings.collect()] == ["https://s.test/shop/pages/offer.php"]
    assert paths(run.crawl.queue) == ["https://s.test/shop/", "https://s.test/shop/menu.js", "https://s.test/shop/pages/offer.php"]


def test_missing_https_seed(spark):
    pages = [("http://s.test/", "text/html", '<a href="/api">x</a>'), ("http://s.test/api", "text/html", "needle")]
    caps = captures(spark, pages)
    got = crawl(caps, frontier(spark, "s.test"), discover=True)
    assert paths(got.queue) == ["https://s.test/", "http://s.test/", "http://s.test/api"]
    assert paths(got.unreachable) == ["https://s.test/"]
    with pytest.raises(ValueError):
        crawl(caps, frontier(spark, "s.test"), strict=True)


def test_scope_over_requests_and_inherited_headers(spark):
    pages = [("http://box.test:9/begin", "text/html", '<a href="/next-api"></a>'), ("http://box.test:9/next-api", "text/html", "needle")]
    rows = spark.createDataFrame(
        [(1, "GET", "http://box.test:9/begin", {"Cookie": ["a", "b"], "User-Agent": ["UA"], "X": ["1"]})],
        "req_ord bigint, method string, url string, headers map<string,array<string>>",
    ).withColumn("body", F.lit(None).cast("binary"))
    run = scan_requests(captures(spark, pages), rows, assemble(custom=["needle"]), scope="box.test:9", discover=True)
    queue = run.crawl.queue.orderBy("queue_ord").collect()
    assert [r["url"] for r in queue] == ["http://box.test:9/begin", "http://box.test:9/next-api"]
    assert queue[1]["headers"] == {"Cookie": ["a"], "User-Agent": ["UA"]}
    assert run.findings.count() == 1
    kept = spark.createDataFrame([({"Accept": [""]},)], "h map<string,array<string>>").select(inherited_headers(F.col("h")))
    assert kept.first()[0] == {}


def test_duplicate_seeds_count_towards_the_cap(spark):
    seeds = frontier(spark, HOST + "/", HOST + "/", scope=HOST)
    got = crawl(captures(spark), seeds, discover=True, max_crawl=3)
    assert paths(got.queue) == ["/", "/", "/feeds/today.xml"]
    assert got.resources.count() == 2


def test_fragments_are_kept_but_not_fetched(spark):
    pages = [("https://s.test/a", "text/html", '<a href="#"></a><a href="#api"></a><a href="/api#x"></a>'), ("https://s.test/api", "text/html", "t")]
    got = crawl(captures(spark, pages), frontier(spark, "https://s.test/a#top", scope="*.test/*"))
    assert paths(got.queue) == ["https://s.test/a#top", "https://s.test/a#api", "https://s.test/api#x"]
    assert sorted(r["final_url"] for r in got.resources.collect()) == ["https://s.test/a#api", "https://s.test/a#top", "https://s.test/api#x"]


def test_findings_carry_lineage(spark):
    got = crawl(captures(spark), frontier(spark, HOST), discover=True)
    fields = ["matched_value", "target_url", "resource_url", "discovered_from", "status", "content_type", "resource_kind", "line"]
    rows = scan(got.resources, assemble(custom=["mate@[a-z.]+"]), fields=fields).collect()
    assert [tuple(r) for r in rows] == [
        ("mate@ferry.test", HOST, HOST + "/feeds/archive/2019.json?page=1", HOST + "/", 200, "application/json", "json", 1)
    ]
