"""Rule engine queries over the pages table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.views import table
from .registry import query

BUNDLE = {
    "navigation": [
        {"key": "off_host", "condition": {"type": "not", "condition": {"type": "url_regex", "pattern": r"example\.(?:com|net|org)"}}, "decision": "SKIP"},
        {"key": "skip_fr", "condition": {"type": "url_regex", "pattern": "/fr/"}, "decision": "SKIP", "priority": 1},
        {"key": "detail", "condition": {"type": "url_regex", "pattern": r"/(?:en|de|es)/\d+"}, "decision": "FETCH", "page_kind": "DETAIL", "priority": 2},
        {"key": "unused", "condition": {"type": "url_regex", "pattern": "/never/"}, "decision": "DEFER", "priority": 3},
    ],
    "extraction": [
        {
            "key": "page", "condition": {"type": "dom_css", "css": "html > head > title"}, "page_kind": "DETAIL",
            "fields": {"title": [{"css": "h1"}, {"css": "title"}], "external_id": [{"document_url": True, "regex": r"/(\d+)"}], "description": [{"css": "p"}], "listing_type": [{"const": "for sale"}], "extra.lang": [{"css": "html", "attr": "lang", "scope": "page"}]},
            "links": [{"css": "nav a[href]", "rel": "CATEGORY"}],
        }
    ],
    "vocab": {"listing_type": [{"pattern": "for sale", "value": "SALE"}, {"pattern": "for rent", "value": "RENT"}]},
}
_SQL = r"CASE WHEN NOT regexp_matches(url, 'example\.(com|net|org)') THEN 'off_host' WHEN contains(url, '/fr/') THEN 'skip_fr' WHEN regexp_matches(url, '/(en|de|es)/\d+') THEN 'detail' END"


def _pages(spark, d):
    return table(spark, d, "pages")


@query("route_urls", f"SELECT page_id, {_SQL} AS node FROM pages")
def route_urls(spark, d):
    return R.route_urls(_pages(spark, d), R.compile_bundle(BUNDLE)[0], key="page_id").select("page_id", "node")


@query("route_native", "SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'skip_fr' WHEN regexp_matches(url, '/(en|de|es)/\\d+') THEN 'detail' END AS node FROM pages")
def route_native(spark, d):
    graph = R.compile_bundle(BUNDLE)[0].revised(remove=["off_host"])
    return _pages(spark, d).select("page_id", R.route_column(graph, F.col("url")).alias("node"))


@query("route_decisions", f"SELECT CASE {_SQL} WHEN 'detail' THEN 'FETCH' WHEN 'skip_fr' THEN 'SKIP' WHEN 'off_host' THEN 'SKIP' ELSE 'UNROUTED' END AS decision, count(*) AS n FROM pages GROUP BY 1")
def route_decisions(spark, d):
    return R.route_urls(_pages(spark, d), R.compile_bundle(BUNDLE)[0], key="page_id").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("compaction_changes", "SELECT page_id FROM pages WHERE false")
def compaction_changes(spark, d):
    return R.compaction(_pages(spark, d), R.compile_bundle(BUNDLE)[0], key="page_id")[1].select("page_id")


def _extracted(spark, d):
    return R.extract_pages(_pages(spark, d), R.compile_bundle(BUNDLE)[1])


@query("extract_pages", r"SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, nullif(regexp_extract(url, '/(\d+)', 1), '') AS external_id FROM pages WHERE regexp_matches(url, '/\d+')".replace('\\"', '"'))
def extract_pages(spark, d):
    rows = _extracted(spark, d).select("page_id", F.explode("drafts").alias("x"))
    return rows.select("page_id", F.col("x.attributes")["lang"].alias("lang"), F.col("x.external_id").alias("external_id"))


@query("extract_links")
def extract_links(spark, d):
    return _extracted(spark, d).select("page_id", F.explode("links").alias("x")).select("page_id", "x.url", "x.rel")


@query("extract_kinds")
def extract_kinds(spark, d):
    return _extracted(spark, d).groupBy("page_kind", "template").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("drafts")).alias("drafts"), F.sum(F.size("problems")).alias("problems"))


@query("page_fingerprints")
def page_fingerprints(spark, d):
    return _extracted(spark, d).select("page_id", "fingerprint")


@query("url_shapes")
def url_shapes(spark, d):
    return R.shapes(_pages(spark, d)).groupBy("shape").agg(F.count(F.lit(1)).alias("occurrences"), F.min("url").alias("sample"))
