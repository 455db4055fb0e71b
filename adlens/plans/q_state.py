"""Queries of stored state: cursors, observation snapshots, labels of imported rows, request counts, compaction."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cursors as C
from ..operators import frontier as Q
from ..operators import merge as G
from ..operators import rules as R
from ..sources.views import LISTING_SQL, listing, table
from .q_rules import BUNDLE
from .registry import query


def _cursors(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    source = F.lit("site").alias("source_key")
    own = c.where(k % 3 == 0).select(source, F.concat(F.lit("index:a:"), k.cast("string")).alias("scope"), F.when(k % 2 == 0, F.col("c_name")).alias("resume_key"), (k % 5 == 0).alias("done"))
    old = c.where(k % 4 == 0).select(source, F.concat(F.lit("index:"), k.cast("string")).alias("scope"), F.concat(F.lit("old "), "c_name").alias("resume_key"), (k % 7 == 0).alias("done"))
    return own.unionByName(old)


def _adopted(spark, d):
    k = F.col("c_custkey").cast("string")
    wanted = table(spark, d, "customer").select(F.lit("site").alias("source_key"), F.concat(F.lit("index:a:"), k).alias("scope"), F.concat(F.lit("index:"), k).alias("legacy"))
    return C.adopt(_cursors(spark, d), wanted)


_ADOPTED = """a AS (SELECT k, 'site' AS source_key, 'index:a:' || k AS scope, CASE WHEN own THEN CASE WHEN k % 2 = 0 THEN c_name END WHEN k % 4 = 0 THEN 'old ' || c_name END AS resume_key,
    CASE WHEN own THEN k % 5 = 0 ELSE k % 28 = 0 END AS done, NOT own AND k % 4 = 0 AS adopted
    FROM (SELECT c_custkey AS k, c_name, c_custkey % 3 = 0 AND (c_custkey % 2 = 0 OR c_custkey % 5 = 0) AS own FROM customer))"""


@query("cursors_adopted", f"WITH {_ADOPTED} SELECT source_key, scope, resume_key, done, adopted FROM a")
def cursors_adopted(spark, d):
    return _adopted(spark, d)


@query("cursors_saved", f"WITH {_ADOPTED} SELECT source_key, scope, resume_key, done FROM a WHERE k % 3 = 0 OR adopted UNION ALL SELECT 'site', 'index:' || c_custkey, 'old ' || c_name, c_custkey % 7 = 0 FROM customer WHERE c_custkey % 4 = 0")
def cursors_saved(spark, d):
    return C.save(_cursors(spark, d), _adopted(spark, d).where("adopted"))


@query(
    "observation_snapshots",
    f"WITH {LISTING_SQL} SELECT external_id, title, description, CAST(price AS VARCHAR) AS price, CAST(area_sqm AS VARCHAR) AS area, CAST(bedrooms AS VARCHAR) AS bedrooms, CAST(is_active AS VARCHAR) AS active, strftime(listed_at, '%Y-%m-%dT%H:%M:%S') AS listed, '{{}}' AS raw FROM listing",
)
def observation_snapshots(spark, d):
    rows = G.snapshot(listing(spark, d))
    at = lambda name: F.get_json_object("snapshot", f"$.{name}")
    return rows.select("external_id", at("title").alias("title"), at("description").alias("description"), at("price").alias("price"), at("area_sqm").alias("area"), at("bedrooms").alias("bedrooms"), at("is_active").alias("active"), at("listed_at").alias("listed"), at("raw").alias("raw"))


_CITIES, _CITY_OF = ["AFRICA", "AMERICA", "EUROPE"], {"CHINA": "ASIA", "INDIA": "ASIA"}


@query(
    "labels_placed",
    f"""WITH {LISTING_SQL}, p AS (SELECT id, split_part(location_name, ', ', 1) AS n, split_part(location_name, ', ', 2) AS r FROM listing),
      k AS (SELECT *, r IN ('AFRICA', 'AMERICA', 'EUROPE') AS city, n IN ('CHINA', 'INDIA') AS below FROM p)
      SELECT id, CASE id % 5 WHEN 0 THEN n WHEN 1 THEN 'Road 9' WHEN 2 THEN r WHEN 3 THEN n ELSE 'World' END AS name,
        CASE WHEN id % 5 IN (0, 2) AND city THEN r WHEN id % 5 = 1 AND below THEN 'ASIA' END AS city,
        CASE id % 5 WHEN 0 THEN CASE WHEN city THEN n ELSE r END WHEN 1 THEN n END AS district,
        CASE WHEN id % 5 IN (0, 2) AND NOT city THEN r WHEN id % 5 = 1 AND NOT below THEN n WHEN id % 5 = 3 THEN n END AS unresolved FROM k""",
)
def labels_placed(spark, d):
    parts = F.split("location_name", ", ")
    n, r, k = parts[0], parts[1], F.col("id") % 5
    label = F.when(k == 0, F.col("location_name")).when(k == 1, F.concat(F.lit("Road 9 ,, "), n)).when(k == 2, r).when(k == 3, n).otherwise("World")
    return listing(spark, d).withColumn("p", scalars.place_of_label(label, _CITIES, _CITY_OF, "World")).select("id", "p.*")


@query("link_request_counts", "WITH s(status) AS (VALUES ('PENDING'), ('FOUND'), ('NONE'), ('FAILED')), e AS (SELECT CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'FOUND' END AS status FROM events) SELECT s.status, count(e.status) AS n FROM s LEFT JOIN e USING (status) GROUP BY 1")
def link_request_counts(spark, d):
    requests = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "FAILED").otherwise("FOUND").alias("status"))
    return Q.status_counts(requests, Q.REQUEST_STATUSES)


@query("compaction_routes", r"SELECT page_id, CASE WHEN NOT regexp_matches(url, 'example\.(com|net|org)') THEN 'off_host' WHEN regexp_matches(url, '/(en|de|es)/\d+') THEN 'detail' END AS node FROM pages")
def compaction_routes(spark, d):
    """Routes by the graph that is left without a rule that pages use and those that none does."""
    pages = table(spark, d, "pages")
    smaller = R.compaction(pages, R.compile_bundle(BUNDLE)[0], ["skip_fr"], key="page_id")[0]
    return R.route_urls(pages, smaller, key="page_id").select("page_id", "node")
