"""A small site as capture rows: a feed and an archive below nested folders, an inline script, a specification, and what was never captured."""

from sievenet.sources.captures import normalize_captures

HOST, OTHER = "https://ferry.test", "https://tiles.ferry-cdn.test"

PAGES = [
    (
        HOST + "/",
        "text/html",
        """<title>Ferries</title>
<p>Next crossings are in the <a href="feeds/today.xml">feed</a>, older ones in the <a href='feeds/archive/2019.json?page=1'>archive</a>.
<p>Ask desk@ferry.test or quay@ferry.test <a href="about.html">about</a> the ticket office: a ticket bought there is a ticket for all lines.
<script>
  const tides = "/services/api/tides?station=4";
</script>""",
    ),
    (
        HOST + "/feeds/today.xml",
        "text/xml",
        f"""<list xmlns="{HOST}/ns">
  <item><link>{HOST}/feeds/lines/north.json</link></item>
  <item><link>{OTHER}/api/deep.json</link></item>
  <note url="../quays/api-list.txt"/>
</list>""",
    ),
    (HOST + "/feeds/archive/2019.json?page=1", "application/json", '{"older": "./2018.json", "described": "/spec/v2/openapi-crossings", "crew": ["mate@ferry.test"]}'),
    (HOST + "/feeds/archive/2018.json", "application/json", "[]"),
    (HOST + "/feeds/lines/north.json", "application/json", f'{{"boats": ["/graphql/boats", "/graphql/boats"], "back": "{HOST}/feeds/today.xml"}}'),
    (HOST + "/quays/api-list.txt", "text/plain", "stations\n//# sourceMappingURL=lists/quays.map\n"),
    (HOST + "/spec/v2/openapi-crossings", "application/json", '{"openapi": "3.1.0", "paths": {"/crossings/{id}": {}}}'),
    (HOST + "/about.html", "text/html", "never reached"),
    (OTHER + "/api/deep.json", "application/json", '{"next": "/api/deeper.json"}'),
]

# Derived by hand: wave by wave, links of a page in the order in which they are found.
QUEUE = [
    "/",
    "/feeds/today.xml",
    "/feeds/archive/2019.json?page=1",
    "/services/api/tides?station=4",
    "/feeds/lines/north.json",
    "/quays/api-list.txt",
    "/feeds/archive/2018.json",
    "/spec/v2/openapi-crossings",
    "/graphql/boats",
    "/quays/lists/quays.map",
]


def captures(spark, pages=PAGES):
    rows = [(i, url, kind, bytearray(body.encode())) for i, (url, kind, body) in enumerate(pages, 1)]
    return normalize_captures(spark.createDataFrame(rows, "capture_id bigint, url string, content_type string, body binary"))
