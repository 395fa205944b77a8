"""Operators on pages and embeddings."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievenet.llm import urlgraph, vectors, warc

PAGES = "page_id bigint, url string, html string, payload int, digest string, host string"


def same(frame, expected):
    assert Counter(tuple(r) for r in frame.collect()) == Counter(map(tuple, expected))


def test_warc(spark):
    rng = random.Random(1)
    bodies = [None, "", "<p>", "é\r\n\r\nWARC/1.1\r\n" * 40, "".join(rng.choice("abcäöü\r\n 0") for _ in range(400_000)), "x" * 65_536, *["<b>%d</b>" % i for i in range(20)]]
    pages = [(i, None if i % 5 == 0 else f"http://h{i % 3}.test/a b\n{i}", bodies[i % len(bodies)]) for i in range(60)] + [(None, "http://x.test/", "<p>"), (None, None, None)]
    frame = spark.createDataFrame([(*p, 1, "d", "h") for p in pages], PAGES).repartition(3)
    got = warc.report(frame)
    assert got.where("problem is not null").count() == 0
    same(got.drop("problem"), brute.warc(pages))
    assert warc.report(frame.limit(0)).count() == 0


def test_warc_faults(spark, tmp_path):
    import gzip

    good = list(warc.records(1, 7, "http://a.test/", b"abc" * 50_000, None, 20_000))
    files = {"short": good[:-1], "swapped": [good[0], *reversed(good[1:])], "broken": [next(warc.records(2, 8, None, b"xyz", None, 1000)).replace(b"xyz", b"xyY")]}
    for name, own in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in own))
        rows = warc.read_archives(spark, str(tmp_path / name)).collect()
        assert [(r.page_id, r.payload_bytes, r.problem) for r in rows] == {"short": [(7, None, "segments missing")], "swapped": [(7, 150_000, None)], "broken": [(8, 3, "digest differs")]}[name]


def test_foreign_archives(spark, tmp_path):
    import gzip

    def record(fields, block=b""):
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("latin-1") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    whole = record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://a.test/\r\n b")], http + b"body")
    parts = [
        record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>")], b"software: x"), whole,
        record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Refers-To", "<urn:uuid:1>")], http),
        record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Target-URI", "http://\xe9.test/")], http),
        record([("WARC-Type", "continuation"), ("WARC-Record-ID", "<urn:uuid:4>"), ("WARC-Segment-Number", "two")], b"x"),
    ]
    files = {
        "all.warc.gz": b"".join(map(gzip.compress, parts)), "plain.warc": b"".join(parts[:2]), "cut.gz": gzip.compress(b"".join(parts[:3]))[:-30], "block.gz": gzip.compress(whole + whole[:-20]),
        "head.warc": whole + b"WARC/1.0\r\nWARC-Ty", "length.warc": whole + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n", "other.gz": gzip.compress(b"<html>\r\n\r\n"), "none.gz": b"\x1f\x8bnonsense", "empty.warc": b"", "end.warc": whole[:-4],
    }
    fine = ("urn:uuid:1", "http://a.test/ b", 4, None, None)
    expected = {
        "all.warc.gz": [fine, ("urn:uuid:2", None, None, "urn:uuid:1", None), ("urn:uuid:3", "http://\ufffd.test/", None, None, "no record referred to"), ("urn:uuid:4", None, None, None, "segment without a number")],
        "plain.warc": [fine], "end.warc": [fine], "empty.warc": [], "block.gz": [fine, ("urn:uuid:1", "http://a.test/ b", None, None, "archive cut off in a block")],
        "head.warc": [fine, (None, None, None, None, "archive cut off in a head")], "length.warc": [fine, (None, None, None, None, "no length: 'many'")], "other.gz": [(None, None, None, None, "not a WARC record: '<html>'")],
    }
    for name, content in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_bytes(content)
        got = warc.read_archives(spark, str(tmp_path / name))
        rows = [tuple(r) for r in got.select("record_id", "url", "payload_bytes", "refers_name", "problem").collect()]
        if name in expected:
            assert Counter(rows) == Counter(expected[name])
        else:
            assert rows[-1][-1].startswith("not gzip" if name == "none.gz" else "archive cut off")
        assert got.where("page_id is not null or refers_to is not null").count() == 0


def test_chunked():
    for size in (0, 1, 16_383, 16_384, 40_000):
        assert warc.dechunked(warc.chunked(b"q" * size)) == b"q" * size
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="cut off"):
        warc.dechunked(b"5\r\nab")


URLS = [
    (1, "http://a.example.net/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "HTTP://A.Example.NET/de", "a.example.net", "/de", "net/", "block"), (3, "https://example.com/de/#f", "example.com", "/de/", "example.com/de/", "block"),
    (4, "x://b.org/fr/?q", "b.org", "/fr/", "org/fr/", "allow"), (5, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), (6, None, "", "", None, "allow"), (7, "no scheme/net/", "", "", None, "allow"),
    (8, "http://net", "net", "", None, "allow"), (9, "http://?x", "", "", None, "allow"), (10, "http://Ärger.ORG/FR/", "Ärger.org", "/FR/", None, "allow"), (11, "http://a/b://c.net/", "a", "/b://c.net/", None, "allow"),
]


def test_url_rules(spark):
    rows = [(i, u, None, 1, "d", "h") for i, u, *_ in URLS]
    got = urlgraph.judge(spark.createDataFrame([*rows, rows[0]], PAGES))
    same(got.select("page_id", "host", "path", "rule", "verdict"), [(i, *rest) for i, _, *rest in [*URLS, URLS[0]]])
    assert urlgraph.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [(1, "http://spam.net/", link("good.org", "good.org")), (2, "http://feeds.io/", link("spam.net", "self.io")), (3, "http://feeds.io/2", link("SPAM.net")), (4, "http://fan.io/", link("feeds.io")), (5, "http://far.io/", link("fan.io", "ok.io", "ok2.io", "ok3.io")), (6, "http://ok.io/", None), (7, "http://seed.org/fr/", link("friend.io", "spam.net")), (8, "http://friend.io/", link("spam.net"))]
    got = {r.page_id: r for r in urlgraph.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    edges = Counter()
    import re

    for _, url, html in pages:
        a = url.split("/")[2]
        edges.update((a, b) for b in {h.lower() for h in re.findall(r"https://([^/]+)/", html or "")} if a != b)
    trust = {h: 0.0 for e in edges for h in e} | {"ok.io": 0.0}
    seeds = {"spam.net": (0, 1), "seed.org": (1, 0)}
    distrust = dict(trust)
    for _ in range(200):
        out, into = Counter(), Counter()
        for (a, b), n in edges.items():
            out[a] += n
            into[b] += n
        trust, distrust = (
            {h: (s := seeds.get(h, (0, 0))[0]) + (1 - s) * 0.85 * sum(n / into[b] * trust[a] for (a, b), n in edges.items() if b == h) for h in trust},
            {h: (s := seeds.get(h, (0, 0))[1]) + (1 - s) * 0.85 * sum(n / out[a] * distrust[b] for (a, b), n in edges.items() if a == h) for h in trust},
        )
    for i, url, _ in pages:
        host = url.split("/")[2]
        assert got[i].trust == pytest.approx(trust[host], abs=1e-4) and got[i].distrust == pytest.approx(distrust[host], abs=1e-4)
        if got[i].rule is None:
            assert got[i].verdict == ("block" if distrust[host] - trust[host] >= urlgraph.LIMIT else "allow")
    assert got[1].verdict == "block" and got[6].verdict == "allow"


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, copies string"


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    near = base[rng.integers(0, 20, 120)] + rng.normal(size=(120, 16)) * 0.1
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(500 + i, base[3].tolist(), 1) for i in range(30)] + [(600 + i, (base[3] * 2).tolist(), 1) for i in range(3)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [1.0, None] + [0.0] * 14, 1), (703, [float("nan")] * 16, 1), (704, [float("inf")] * 16, 1), (705, base[3].tolist(), None), (706, [], 1), (707, base[3].tolist()[:8], 1)]
    frame = spark.createDataFrame([(*r, "i", "c") for r in rows], VECTORS).repartition(3)
    expected = brute.vectors(rows)
    assert sum(r[1] > 0 for r in expected) > 50
    same(vectors.near_duplicates(frame), expected)
    same(vectors.near_duplicates(frame, shard=40), expected)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0
    nameless = vectors.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1, "", ""), (1, [1.0, 2.0], 1, "", "")], VECTORS))
    same(nameless, [(None, 0, None, True), (1, 0, 1, True)])


def test_doubles_are_compared_as_given(spark):
    rows = [(1, [1e39, 0.0], 1), (2, [1e39, 0.0], 1), (3, [2e300, 1e290], 1), (4, [1e-300, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 1e-9], 2), (7, [float("inf"), 0.0], 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    same(got.drop("kept"), [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 0, 6), (7, 0, 7)])


def test_graph_finds_neighbours():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 32))
    held = np.concatenate([base, base[:400] + rng.normal(size=(400, 32)) * 0.08, base[:1] + rng.normal(size=(300, 32)) * 0.05]).astype(np.float32)
    unit = vectors._unit(held)
    true = unit @ unit.T >= 0.98
    q, v = vectors.linked(vectors.Graph(unit.astype(np.float32)), held, held, 0.98)
    assert true[q, v].all() and len(q) >= 0.97 * true.sum()


def test_link_pattern(spark):
    html = """<a href='//One.test/x'><a HREF = "http://two.test:80?x"><a href=https://three.test><a href="/local"><img src="http://no.test/">"""
    rows = spark.createDataFrame([("self.test", html)], "host string, html string")
    same(urlgraph.host_links(rows).select("b", "n"), [("one.test", 1), ("two.test:80", 1), ("three.test", 1)])
    assert urlgraph.host_links(rows.where(F.lit(False))).count() == 0
