"""Values, DOM, conditions, graphs, templates, file sources and the streaming fold."""
import json
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from adlens.functions import html as H
from adlens.functions import parse as P
from adlens.functions import scalars as X
from adlens.functions.urls import absolute
from adlens.operators import rules as R
from adlens.sources import files as S


PRICES = [
    ("3b , Red Sea - 126322 GBP", "", (Decimal("126322.00"), "GBP", "TOTAL")),
    ("ج.م35,500", "RENT", (Decimal("35500.00"), "EGP", "PER_MONTH")),
    ("بمقدم 132 ألف", "", (Decimal("132000.00"), None, "INSTALLMENT")),
    ("Call for price", "", (None, None, "ON_REQUEST")),
    ("$8", "", (None, "USD", "UNKNOWN")),
    ("8 USD per night", "", (Decimal("8.00"), "USD", "PER_NIGHT")),
    ("1.5m EGP", "", (Decimal("1500000.00"), "EGP", "TOTAL")),
    ("100 sqm for 2,000 EGP", "", (Decimal("2000.00"), "EGP", "TOTAL")),
    ("120 000 or 95000", "RENT", (Decimal("120000.00"), None, "PER_MONTH")),
    ("9999999999999 EGP", "", (None, "EGP", "UNKNOWN")),
    ("", "", (None, None, "UNKNOWN")),
    (None, "", (None, None, "UNKNOWN")),
]


def column(spark, values, make, kind="string"):
    """``make`` of each value, as a column."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows, key=lambda r: r.i)]


def test_price(spark):
    got = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(PRICES)], "i int, t string, k string").select("i", P.price(F.col("t"), F.col("k")).alias("p")).orderBy("i").collect()
    for (text, _, want), r in zip(PRICES, got, strict=True):
        assert tuple(r.p) == want, text


def test_area_counts_periods(spark):
    assert column(spark, ["650 M", "1,000 sq ft", "3 m", None], X.area_sqm) == [Decimal("650.00"), Decimal("92.90"), None, None]
    assert column(spark, ["غرفتين", "3 beds", "99", "three beds", "threesome", None], P.small_count) == [2, 3, None, 3, None, None]
    assert column(spark, ["monthly", "monthly or weekly", "daily", None], P.rental_period) == ["PER_MONTH", None, "PER_NIGHT", None]
    assert [[float(x) for x in r] for r in column(spark, ["2 million, 1.5k or ٣٥٬٥٠٠", "none"], P.numbers)] == [[2_000_000, 1_500, 35_500], []]


CAPTURE = datetime(2013, 3, 5, tzinfo=UTC)
DATES = {
    "2013-01-31": (2013, 1, 31), "5 March 2012": (2012, 3, 5), "27 Dec": (2012, 12, 27), "Feb 3rd, 2013": (2013, 2, 3), "1/25/2013": (2013, 1, 25), "25/1/13": (2013, 1, 25),
    "yesterday": (2013, 3, 4), "اليوم": (2013, 3, 5), "2 days ago": (2013, 3, 3), "منذ يومين": (2013, 3, 3), "13 hours and 4 minutes ago": (2013, 3, 4, 10, 56), "1362441600": (2013, 3, 5),
    "1362441600000": (2013, 3, 5), "2013-02-28 10:30": (2013, 2, 28, 10, 30), "٣ فبراير ٢٠١٣": (2013, 2, 3), "31 February 2013": None, "1990-01-01": None, "2014-01-01": None, "nonsense": None, "": None,
}


def test_dates(spark):
    got = column(spark, list(DATES), lambda c: P.listed_at(c, F.lit(CAPTURE)))
    assert dict(zip(DATES, got, strict=True)) == {t: w and datetime(*w) for t, w in DATES.items()}


def test_places(spark):
    aliases, coarse = {"Cairo": ["القاهرة", "el qahira"], "New Cairo": [], "Giza": ["الجيزة"]}, ["Giza"]
    got = column(spark, ["Flat in New  Cairo", "القاهره، مصر", "giza-cairo", "Gizah", None], lambda c: P.named_place(c, aliases, coarse))
    assert got == ["New Cairo", None, "Cairo", None, None] or got == ["New Cairo", "Cairo", "Cairo", None, None]
    assert column(spark, ["Café Égalité", "أحمد إلى"], P.fold_place) == ["cafe egalite", "احمد الي"]
    assert column(spark, ["egypt", "Egypt, Cairo", None], lambda c: F.coalesce(P.is_named(c, ["Egypt"]), F.lit(False))) == [True, False, False]
    got = column(spark, ["Maadi, Cairo", "Cairo, Cairo", "x, Maadi", "a, b", "Cairo", "Egypt", "Nowhere", None], lambda c: P.city_district(c, ["Cairo"], {"Maadi": "Cairo"}))
    assert [tuple(r) for r in got] == [("Cairo", "Maadi", None), ("Cairo", None, None), ("Cairo", "Maadi", None), (None, "b", "b"), ("Cairo", None, None), (None, None, None), (None, None, "Nowhere"), (None, None, None)]


def test_urls(spark):
    cases = ["http://www.portal.com.eg:80/Search/?b=2&a=1#x", "HTTPS://a.b.example.com:8443/x/", "example.com", "http://example.com/?q="]
    assert column(spark, cases, X.surt_key) == ["eg,com,portal)/search?a=1&b=2", "com,example,b,a:8443)/x", "com,example)/", "com,example)/?q"]
    shapes = {
        "http://cairo.sub.example.com/en/ads/big-flat-ID8igUm.html?p=2": "*.sub.example.com/en/ads/*-X.html|d2|q:p", "http://www.a.com": "a.com/|d0", "a.com/": "a.com/|d0",
        "http://m.x.example.com/123456/some-words/item-55-66/?b=&a=1": "m.x.example.com/*/some-words/*-X|d3|q:a,b", "http://a.com/%D8%B4%D9%82%D8%A9": "a.com/*|d1", "http://a.com/b/c.html": "a.com/b/*.html|d2",
    }
    assert dict(zip(shapes, column(spark, list(shapes), P.url_shape), strict=True)) == shapes
    assert absolute("/web/1", "http://web.archive.org/web/2013/http://a.com/b") == "http://a.com/web/1"
    assert absolute("mailto:x", "http://a.com") is None


PAGE = """<html lang="en"><head><title>Flats for rent | Site</title><script>window.state = {"hits": [{"id": 7, "name": {"en": "Big flat"}, "price": "9000 EGP", "loc.lvl1": {"name": "Cairo"}, "slug": "big"}, {"id": 8, "name": "No price"}]}; var x = {bad};</script>
<script type="application/ld+json">{"@type": "Thing"}</script></head><body id="main"><ul class="list big"><li class="ad"><a href="/ad/one-ID11.html">Nice flat 3000 EGP</a><span class="p">3000 EGP</span></li>
<li class="ad"><a href="/ad/two-ID12.html">Villa</a><span class="p" data-x="%7B%22k%22%3A%205%7D">call for price</span></li><li><a href="/ad/one-ID11.html">again</a></li></ul><a class="next" href="?page=2">next</a></body></html>"""


def test_dom():
    root = H.parse(PAGE)
    assert [n.attrs["href"] for n in H.select(root, "ul.list > li.ad a[href$='.html']")] == ["/ad/one-ID11.html", "/ad/two-ID12.html"]
    assert len(H.select(root, "li:has(> span.p), a.next")) == 3
    assert len(H.select(H.select(root, "ul")[0], "> li")) == 3
    scripts, problems = H.script_json(root)
    assert scripts["state"]["hits"][0]["id"] == 7 and scripts["window.state"] is scripts["state"] and scripts["ld+json"] == [{"@type": "Thing"}] and problems == ["malformed_json:x"]
    assert H.resolve(scripts["state"], "hits[0].loc.lvl1.name") == ["Cairo"] and H.resolve(scripts, "state.hits[*].id") == [7, 8]
    with pytest.raises(H.SelectorError):
        H.select(root, "!!")
    assert R.bits(H.simhash(H.structure(root, scripts)), H.simhash(H.structure(root, scripts))) == 0


VOCAB = {"listing_type": [{"pattern": "for rent", "value": "RENT"}], "property_type": [{"pattern": "villa", "value": "VILLA"}, {"pattern": "flat", "value": "APARTMENT"}]}
LIST = {"page_kind": "LIST", "items": {"css": "li.ad"}, "fields": {"title": {"css": "a"}, "url": {"css": "a", "attr": "href"}, "price": {"css": ".p"}, "extra.k": {"css": ".p", "attr": "data-x", "decode": "urlencoded_json", "json": "k"}}, "links": [{"css": "a.next", "rel": "PAGINATION"}]}
JSON = {"page_kind": "LIST", "items": {"script": "state", "path": "hits"}, "fields": {"title": {"json": "name"}, "external_id": {"json": "id"}, "price": {"json": "price"}, "city": {"json": "loc.lvl1"}, "url": {"template": "/ad/{slug}-ID{id}.html"}}, "required_fields": ["price"]}


def graph(*specs, vocab=VOCAB):
    rules = tuple(R.Rule(f"t{i}", "TEMPLATE", spec) for i, spec in enumerate(specs))
    return R.Graph(rules, tuple(R.Edge(R.ROOT, r.key, {"type": "always"}, i) for i, r in enumerate(rules)), vocab)


def extracted(spark, specs, pages=(("http://a.com/rent", PAGE),), **options):
    df = spark.createDataFrame([(i, u, h, CAPTURE) for i, (u, h) in enumerate(pages)], "page_id int, url string, html string, at timestamp")
    return [r for r in R.extract_pages(df, graph(*specs), at_col="at", **options).orderBy("page_id").collect()]


IDENTITY = R.Identity((r"-ID(\d+)\.html",))


def test_templates(spark):
    (r,) = extracted(spark, [LIST], identity=IDENTITY)
    assert [(d.external_id, d.price, d.price_type, d.property_type, d.attributes) for d in r.drafts] == [("11", 3000.0, "PER_MONTH", "APARTMENT", {}), ("12", None, "ON_REQUEST", "VILLA", {"k": "5"})]
    assert [tuple(x) for x in r.links] == [("http://a.com/ad/one-ID11.html", "DETAIL"), ("http://a.com/ad/two-ID12.html", "DETAIL"), ("http://a.com/rent?page=2", "PAGINATION")]
    assert r.drafts[0].observed_at == CAPTURE.replace(tzinfo=None) and not r.drafts[0].is_active and r.drafts[0].price_source == "field"
    (j,) = extracted(spark, [JSON], identity=IDENTITY)
    assert [(d.external_id, d.title, d.city, d.price) for d in j.drafts] == [("7", "Big flat", "Cairo", 9000.0)]
    assert j.problems == ["item 1: missing required fields ['price']"]
    with pytest.raises(ValueError):
        R.Template({"page_kind": "LIST"}, {})
    page = R.Page("http://a.com/rent", PAGE, CAPTURE)
    assert R.advert_links(page, IDENTITY) == 2
    (c,) = extracted(spark, [{**LIST, "links": [], "fields": {**LIST["fields"], "external_id": {"const": "99"}}}], identity=IDENTITY)
    assert c.page_kind is None and c.problems == ["t0: 2 items, 0 drafts; item 0: identity conflict: url says 11, template says 99; item 1: identity conflict: url says 12, template says 99"]


def test_best_template_counts(spark):
    one = {**LIST, "items": {"css": "li.ad:has(> span.p)"}, "fields": {"title": {"css": "a"}, "url": {"css": "a", "attr": "href"}}}
    fewer = {**JSON, "links": []}
    pages = [("http://a.com/rent", PAGE), ("http://b.com/x", "<p>nothing"), (None, None), ("http://a.com/rent", PAGE)]
    got = extracted(spark, [fewer, one, {"page_kind": "LIST"}, LIST], pages, identity=IDENTITY)
    assert [r.template for r in got] == ["t3", None, None, "t3"]
    assert got[1].problems == ["t0: 0 items, 0 drafts", "t1: 0 items, 0 drafts", "t2: a LIST template needs items", "t3: 0 items, 0 drafts"]
    assert extracted(spark, [], pages)[0].problems == ["no template's conditions hold"]


def test_draft_values(spark):
    detail = {
        "page_kind": "DETAIL", "allow_title_price": True, "fields": {
            "title": {"css": "h1"}, "listing_type": {"const": "for rent"}, "price": {"css": ".p", "regex": r"from (\d+)"}, "currency": {"css": ".c"}, "price_period": {"css": ".per"}, "city": {"css": ".city"},
            "area": {"css": ".area"}, "bedrooms": {"css": ".b"}, "listed_at": {"css": ".d"}, "latitude": {"const": "30.5"}, "longitude": {"const": "200"}, "image": {"css": "img", "attr": "src"}, "district": {"css": ".none"},
        },
    }
    html = "<title>x</title><h1>Nice villa in Paris</h1><i class=p>from 5 up to 900 EGP</i><i class=c>usd</i><i class=per>weekly</i><i class=city>al qahira</i><i class=area>120 m</i><i class=b>two</i><i class=d>3 days ago</i><img src=/i.png>"
    places = R.Places({"Cairo": ["al qahira"]}, (), ("Egypt",), ("Paris",))
    (r,) = extracted(spark, [detail], [("http://a.com/ad/9", html)], places=places)
    (d,) = r.drafts
    assert (d.price, d.price_source, d.currency, d.price_type, d.city, d.area_sqm, d.bedrooms, d.listed_at, d.latitude) == (900.0, "field_fulltext", "USD", "PER_WEEK", "Cairo", 120.0, 2, datetime(2013, 3, 2), None)
    assert d.attributes == {"image": "http://a.com/i.png", "_flag": "foreign_location_signal:Paris"} and d.external_id.startswith("u:") and d.url == "http://a.com/ad/9"
    assert r.empty_fields == ["district"] and r.vocab_misses == []
    (titled,) = extracted(spark, [{**detail, "fields": {**detail["fields"], "price": {"css": ".none"}, "title": {"const": "Villa 4000 EGP"}}}], [("http://a.com/ad/9", html)])
    assert (titled.drafts[0].price, titled.drafts[0].price_source, titled.drafts[0].currency) == (4000.0, "title", "EGP")
    (lost,) = extracted(spark, [{**detail, "fields": {**detail["fields"], "listing_type": {"const": "barter"}}}], [("http://a.com/ad/9", html)])
    assert lost.problems == ["t0: 1 items, 0 drafts; item 0: listing type unknown (no vocabulary match)"]


def test_conditions():
    page = R.Page("http://a.com/x", PAGE, CAPTURE, {"linked_as": ["LIST"]})
    yes = [{"type": "always"}, {"type": "url_regex", "pattern": "/X"}, {"type": "evidence", "key": "linked_as", "equals": "LIST"}, {"type": "capture_range", "from": "2013", "to": "2013-03"}, {"type": "dom_css", "css": "li", "min": 3, "max": 3}, {"type": "text_regex", "pattern": "villa"}, {"type": "json_path", "script": "state", "path": "hits", "value_type": "array", "min": 2}, {"type": "template_fp", "fingerprint": page.fingerprint}]
    no = [{"type": "not", "condition": {"type": "always"}}, {"type": "url_regex", "pattern": "("}, {"type": "spacy_match", "patterns": []}, {"type": "nonsense"}, {"type": "json_path", "script": "state", "path": "none", "value_type": "array", "min": 0}]
    assert all(R.holds(c, page) for c in yes) and not any(R.holds(c, page) for c in no)
    assert R.holds({"type": "all", "conditions": yes}, page) and R.holds({"type": "any", "conditions": [*no, yes[0]]}, R.Page("http://a.com/x", PAGE)) is False
    assert not R.holds({"type": "capture_range", "to": "2012-02"}, R.Page("u", None, datetime(2012, 2, 29, tzinfo=UTC)))  # a month ends on its 28th in February


def test_graph(spark):
    rules = (R.Rule("s", "STATE"), R.Rule("a", "ROUTE", {"decision": "SKIP"}), R.Rule("b", "ROUTE", {"decision": "FETCH", "page_kind": "FROM_EVIDENCE", "priority": 400}))
    edges = (R.Edge(R.ROOT, "s", {"type": "always"}), R.Edge("s", "s", {"type": "always"}), R.Edge("s", "b", {"type": "always"}, 2), R.Edge("s", "a", {"type": "url_regex", "pattern": "skip"}, 1))
    g = R.Graph(rules, edges)
    assert R.route(g, R.Page("http://a/skip")) == ("SKIP", "a", 50, "OTHER")
    assert R.route(g, R.Page("http://a/x", evidence={"linked_as": ["DETAIL"]})) == ("FETCH", "b", 100, "DETAIL")
    less = g.revised(remove=["a"])
    assert less.version == 2 and R.route(less, R.Page("http://a/skip"))[1] == "b"
    assert R.cluster_fingerprints(["00", "01", "ffff"], most=2) == {"00": "00", "01": "00", "ffff": "ffff"}
    urls = lambda *us: spark.createDataFrame([(u,) for u in us], "url string")
    assert R.validate_routes([("x", "/ads/"), ("all", "."), ("bad", "(")], urls("http://a/ads/1"), urls("http://a/ads/1", "http://a/b"))[0] == ["x"]
    assert R.validate_routes([("x", "/ads/")], urls("http://a/1", "http://a/2", "http://a/ads/3"), urls("http://a/1")) == ([], ["covers too few of the misses"])
    assert R.seed_plan(R.Graph((R.Rule("i", "ROUTE", {}, "LLM"),), (R.Edge(R.ROOT, "i", {"type": "always"}),)), g).edges[-1].end == "i"
    assert [v.version for v in R.save_version(R.save_version([], g), g)] == [1, 2]


def test_gold(spark):
    pages = spark.createDataFrame([(1, "http://a.com/rent", PAGE)], "page_id int, url string, html string")
    item = (1, "11", "Nice flat 3000 EGP", "3000", "EGP", "RENT")
    gold = spark.createDataFrame([item, (*item[:2], "other", *item[3:]), (2, *item[1:])], "page_id int, external_id string, title string, amount string, currency string, listing_type string")
    got = R.gold_rate(R.extract_pages(pages, graph(LIST), identity=IDENTITY), gold).first()
    assert (got.total, got.exact) == (3, 1) and R.gold_rate(R.extract_pages(pages, graph(LIST)), gold.where("false")).first().rate == 1.0
    better = R.validate_template(pages, gold, graph({**LIST, "items": {"css": "none"}, "links": []}), graph(LIST), identity=IDENTITY).first()
    assert better.accepted and (better.taken, better.items, better.drafts) == (1, 2, 2) and better.rate_before == 0
    worse = R.validate_template(pages, gold, graph(LIST), graph(JSON), identity=IDENTITY).first()
    assert not worse.accepted and worse.rate_after < worse.rate_before


def test_redaction(spark):
    texts = ["mail a.b@c.com now", "call 01012345678", "+1-543-555-1435 x", "nothing"]
    assert [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.redact(F.col("t")).alias("t")).collect()] == ["mail [redacted] now", "call [redacted]", "[redacted] x", "nothing"]


def test_sources(spark, tmp_path):
    item = {"id": 1, "title": "Flat", "purpose": "rent", "category": "flat", "price": {"value": "10.5", "period": "monthly"}, "location": {"city": "Cairo"}, "beds": 2, "created_at": "2024-01-02T03:04:05Z"}
    (tmp_path / "a.json").write_text(json.dumps({"results": [item, {"id": 2}, "junk"]}))
    rows = S.listing_drafts(S.json_files(spark, str(tmp_path / "*.json"))).collect()
    assert [(r.external_id, r.listing_type, r.property_type, r.price, r.currency, r.price_type, r.location_name, r.bedrooms) for r in rows] == [("1", "RENT", "APARTMENT", 10.5, "USD", "PER_MONTH", "Unknown", 2)]
    hit = {"_source": {"externalID": "9", "title": "T", "purpose": "for-sale", "location.lvl1": {"name": "Cairo"}, "extraFields": {"price": 5, "payment_option": "2", "down_payment": 1, "type": "4", "rooms": "10+"}, "state": "active", "slug": "s", "createdAt": 1362441600}}
    body = json.dumps({"responses": [{"hits": {"hits": [hit, {"_source": {}}]}}]})
    got = S.search_drafts(spark.createDataFrame([(body, "apartments-duplex-for-sale")], "content string, category string")).collect()
    assert [(r.external_id, r.property_type, r.price_type, r.bedrooms, r.city, r.url, r.is_active) for r in got] == [("9", "STUDIO", "INSTALLMENT", 10, "Cairo", "https://example.com/ad/s-ID9.html", True)]
    cdx = json.dumps([["urlkey", "timestamp", "original", "digest"], ["com,a)/", "2013", "http://a.com", "D"], ["short"], [], ["next"]])
    files = spark.createDataFrame([("f", cdx), ("g", "[]")], "file string, content string")
    assert [(r.url_key, r.digest) for r in S.captures(files).collect()] == [("com,a)/", "D")]
    assert {r.file: r.resume_key for r in S.resume_keys(files).collect()} == {"f": "next", "g": None}
    gold = json.dumps({"verified": True, "items": [{"external_id": "1", "title": "t", "amount": "3.5", "currency": "EGP", "listing_type": "RENT"}]})
    assert S.gold_items(spark.createDataFrame([("f", gold), ("g", '{"verified": false, "items": [{}]}')], "file string, content string")).count() == 1
    folder = tmp_path / "src/2024/01/02"
    folder.mkdir(parents=True)
    (folder / "x.html").write_bytes("<p>سلام</p>".encode("cp1256"))
    row = S.html_text(S.blobs(spark, str(tmp_path / "src"))).first()
    assert row.html == "<p>سلام</p>" and str(row.day) == "2024-01-02"
    with pytest.raises(ValueError):
        S.blob_key("Bad Key", "x", CAPTURE, "html")


def test_stream_equals_batch(spark, tmp_path):
    from adlens.operators.merge import history, rebuild
    from adlens.streaming.ingest import fold, sightings_stream, state

    schema = "source_key string, external_id string, observed_at timestamp_ntz, document_id long, position int, historical boolean, bedrooms int, price double"
    rows = [("s", str(i % 7), datetime(2024, 1, 1 + (i * 5) % 28), i, 0, True, None if i % 3 else i, float(i)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = fold(spark, sightings_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    pick = lambda df: sorted((r.external_id, r.bedrooms, r.price) for r in df.collect())
    assert pick(state(spark, str(tmp_path / "out"), q.lastProgress["batchId"])) == pick(rebuild(history(spark.createDataFrame(rows, schema))))
