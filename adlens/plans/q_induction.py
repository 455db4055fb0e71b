"""Induction queries: rules for what the rules over ``pages`` miss, and designs among fingerprints."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import induction as I
from ..operators import rules as R
from ..operators import wrappers as W
from ..sources.views import table
from .q_rules import BUNDLE
from .registry import query


def _start() -> R.Graph:
    """Routes that skip foreign hosts and French pages; all else is missed."""
    return R.compile_bundle(BUNDLE)[0].revised(remove=["detail", "unused"])


_ESCAPED = r"regexp_replace({0}, '([.+*?()|{{}}\[\]^$\\])', '\\\1', 'g')"
_PATTERNS_SQL = rf"""
  u AS (SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace({_ESCAPED.format("path")}, '/+$', ''), '[^/]{{16,}}', '[^/]+', 'g'), '\d+', '\\d+', 'g') AS form, {_ESCAPED.format("regexp_extract(host, '([^.]*[.]?[^.]*)$', 1)")} AS domain FROM u WHERE host <> ''),
  p AS (SELECT url, ['^[a-z]+://' || {_ESCAPED.format("host")} || form || '/?(?:[?#]|$)', '^[a-z]+://(?:[^/?#]+\.)?' || domain || form || '/?(?:[?#]|$)', '^[a-z]+://[^/?#]+' || form || '/?(?:[?#]|$)',
    '^[a-z]+://(?:[^/?#]+\.)?' || domain || regexp_extract(form, '^(/[^/]*)/', 1) || '/'] AS ps FROM f)"""


@query(
    "induced_routes",
    rf"""WITH RECURSIVE {_PATTERNS_SQL},
  fair AS (SELECT pattern FROM (SELECT unnest(ps) AS pattern FROM p) GROUP BY 1 HAVING count(*) < 0.9 * (SELECT count(*) FROM pages)),
  g AS (SELECT ps, count(*) AS n, row_number() OVER () AS id FROM p WHERE NOT contains(url, '/fr/') AND regexp_matches(url, 'example\.(?:com|net|org)') GROUP BY ps),
  e AS (SELECT * FROM (SELECT id, n, unnest(ps) AS pattern, unnest(range(4)) AS width FROM g) SEMI JOIN fair USING (pattern)),
  r AS (SELECT 0 AS step, id, '' AS pattern, CAST(0 AS HUGEINT) AS gain, CAST(0 AS BIGINT) AS width, false AS covered FROM (SELECT DISTINCT id FROM e)
    UNION ALL
    SELECT step + 1, id, any_value(pick), any_value(picked), any_value(wide), bool_or(own = pick) FROM (
      SELECT *, first_value(own) OVER b AS pick, first_value(total) OVER b AS picked, first_value(w) OVER b AS wide FROM (
        SELECT r.step, e.id, e.pattern AS own, sum(e.n) OVER (PARTITION BY e.pattern) AS total, min(e.width) OVER (PARTITION BY e.pattern) AS w FROM r JOIN e USING (id) WHERE NOT r.covered) WINDOW b AS (ORDER BY total DESC, w, own))
    GROUP BY step, id)
  SELECT DISTINCT pattern, CASE width WHEN 0 THEN 'host and path' WHEN 1 THEN 'domain and path' WHEN 2 THEN 'path' ELSE 'domain and first segment' END AS width, CAST(gain AS BIGINT) AS gain,
    'FETCH' AS decision, CASE WHEN contains(pattern, '\d+') THEN 'DETAIL' ELSE 'LIST' END AS page_kind FROM r WHERE step > 0""",
)
def induced_routes(spark, d):
    """Rules for the missed pages, where a rule may be of any number of shapes."""
    made = I.induce_routes(table(spark, d, "pages"), _start(), limits=I.RouteLimits(reach=1.0))[1]
    return spark.createDataFrame([(m["pattern"], m["width"], m["gain"], m["decision"], m["page_kind"]) for m in made], "pattern string, width string, gain long, decision string, page_kind string")


@query("induced_decisions", "SELECT CASE WHEN contains(url, '/fr/') OR NOT regexp_matches(url, 'example\\.(com|net|org)') THEN 'SKIP' ELSE 'FETCH' END AS decision, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1")
def induced_decisions(spark, d):
    """With the limits of production: no page of a host is left unrouted."""
    pages = table(spark, d, "pages").where("url is not null")
    return R.route_urls(pages, I.induce_routes(pages, _start())[0], key="page_id").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


#: Parts as pages: a design is a brand, and a part's size changes one digit of its fingerprint.
_PRINT_SQL = "SELECT p_partkey AS position, p_brand, left(md5(p_brand), p_size % 16) || substr('0123456789abcdef', 1 + p_size % 16, 1) || substr(md5(p_brand), p_size % 16 + 2, 15 - p_size % 16) AS fingerprint FROM part"


@query("design_clusters", f"WITH f AS ({_PRINT_SQL}) SELECT DISTINCT fingerprint, first_value(fingerprint) OVER (PARTITION BY p_brand ORDER BY position) AS leader FROM f")
def design_clusters(spark, d):
    at, whole = F.col("p_size") % 16, F.md5("p_brand")
    changed = F.concat(F.substring(whole, F.lit(1), at), F.substring(F.lit("0123456789abcdef"), at + 1, F.lit(1)), F.substring(whole, at + 2, 15 - at))
    return I.cluster_designs(table(spark, d, "part").select(F.col("p_partkey").alias("position"), changed.alias("fingerprint")))


@query("induced_templates")
def induced_templates(spark, d):
    reports = W.induce_templates(table(spark, d, "pages"), R.Graph((), (), {}))[1]
    return spark.createDataFrame([(r["leader"], r["pages"], r["kind"], r["attempts"], r["accepted"]) for r in reports], "leader string, pages long, kind string, attempts long, accepted boolean")
