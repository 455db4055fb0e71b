"""Merge queries: sightings are lineitems, an advert is a part."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as G
from ..sources.views import LISTING_SQL, OBSERVATION_SQL, listing, observation, table
from .registry import query

_SIGHT_SQL = """sight AS (SELECT 'li' AS source_key, CAST(l_partkey AS VARCHAR) AS external_id, l_shipdate AS observed_at, l_orderkey AS document_id, l_linenumber AS position,
  CAST(l_extendedprice AS DOUBLE) AS price, CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey % 5 END AS bedrooms, CASE WHEN l_orderkey % 4 = 0 THEN l_quantity END AS area_sqm,
  CASE WHEN l_orderkey % 5 = 0 THEN 'unknown' ELSE 'place ' || l_suppkey % 7 END AS location_name, l_orderkey % 50 <> 0 AS historical, md5(l_returnflag || l_linestatus) AS content_hash FROM lineitem)"""
_ORDER = "observed_at, document_id, position"


def sightings(spark, d):
    return table(spark, d, "lineitem").select(
        F.lit("li").alias("source_key"), F.col("l_partkey").cast("string").alias("external_id"), F.col("l_shipdate").alias("observed_at"), F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").alias("position"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 5).alias("bedrooms"),
        F.when(F.col("l_orderkey") % 4 == 0, F.col("l_quantity")).alias("area_sqm"),
        F.when(F.col("l_orderkey") % 5 == 0, "unknown").otherwise(F.concat(F.lit("place "), (F.col("l_suppkey") % 7).cast("string"))).alias("location_name"),
        (F.col("l_orderkey") % 50 != 0).alias("historical"), F.md5(F.concat("l_returnflag", "l_linestatus")).alias("content_hash"),
    )


@query("batch_collapse", f"WITH {_SIGHT_SQL} SELECT external_id, observed_at, document_id, position, price FROM sight QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY observed_at DESC, position DESC, document_id DESC) = 1")
def batch_collapse(spark, d):
    # Positions of a batch are unique; here the document breaks their ties.
    rows = sightings(spark, d)
    rows = rows.withColumn("position_in_line", F.col("position")).withColumn("position", F.struct("position", "document_id"))
    return G.collapse(rows).select("external_id", "observed_at", "document_id", F.col("position_in_line").alias("position"), "price")


@query("observation_history", f"WITH {_SIGHT_SQL} SELECT external_id, observed_at, document_id, position, price FROM sight QUALIFY row_number() OVER (PARTITION BY external_id, observed_at ORDER BY document_id DESC, position DESC) = 1")
def observation_history(spark, d):
    return G.history(sightings(spark, d)).select("external_id", "observed_at", "document_id", "position", "price")


@query(
    "observation_policy",
    f"""WITH {_SIGHT_SQL}, c AS (SELECT external_id, document_id, position, historical, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN lag(content_hash) OVER w = content_hash THEN 'unchanged' ELSE 'updated' END AS change
      FROM sight WINDOW w AS (PARTITION BY external_id ORDER BY {_ORDER})) SELECT external_id, document_id, position, change FROM c WHERE historical OR change <> 'unchanged'""",
)
def observation_policy(spark, d):
    return G.observation_policy(sightings(spark, d)).select("external_id", "document_id", "position", "change")


@query(
    "upsert_counts",
    f"""WITH {_SIGHT_SQL}, c AS (SELECT CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN lag(content_hash) OVER w = content_hash THEN 'unchanged' ELSE 'updated' END AS outcome
      FROM sight WINDOW w AS (PARTITION BY external_id ORDER BY {_ORDER})) SELECT outcome, count(*) AS n FROM c GROUP BY 1""",
)
def upsert_counts(spark, d):
    return G.upsert_counts(sightings(spark, d))


@query(
    "rebuild_state",
    f"""WITH {_SIGHT_SQL}, e AS (SELECT *, sum(CASE WHEN historical THEN 0 ELSE 1 END) OVER (PARTITION BY external_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS epoch FROM sight),
      c AS (SELECT external_id, observed_at, document_id, position, price, bedrooms AS b0, area_sqm AS a0,
        last_value(bedrooms IGNORE NULLS) OVER w AS bedrooms, last_value(area_sqm IGNORE NULLS) OVER w AS area_sqm,
        last_value(CASE WHEN bedrooms IS NOT NULL THEN document_id END IGNORE NULLS) OVER w AS bd, last_value(CASE WHEN area_sqm IS NOT NULL THEN document_id END IGNORE NULLS) OVER w AS ad,
        coalesce(last_value(CASE WHEN location_name <> 'unknown' THEN location_name END IGNORE NULLS) OVER w, location_name) AS location_name
        FROM e WINDOW w AS (PARTITION BY external_id, epoch ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)),
      f AS (SELECT *, min(observed_at) OVER (PARTITION BY external_id) AS first_observed_at, max(observed_at) OVER (PARTITION BY external_id) AS last_observed_at, count(*) OVER (PARTITION BY external_id) AS sightings FROM c)
      SELECT external_id, price, bedrooms, area_sqm, location_name, first_observed_at, last_observed_at, sightings,
        concat_ws(',', CASE WHEN a0 IS NULL AND area_sqm IS NOT NULL THEN 'area_sqm=' || ad END, CASE WHEN b0 IS NULL AND bedrooms IS NOT NULL THEN 'bedrooms=' || bd END) AS provenance
      FROM f QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY observed_at DESC, document_id DESC, position DESC) = 1""",
)
def rebuild_state(spark, d):
    return G.rebuild(sightings(spark, d)).select("external_id", "price", "bedrooms", "area_sqm", "location_name", "first_observed_at", "last_observed_at", "sightings", "provenance")


@query("upsert_history", f"WITH {_SIGHT_SQL} SELECT external_id, observed_at, document_id, position, price FROM sight QUALIFY row_number() OVER (PARTITION BY external_id, observed_at ORDER BY document_id DESC, position DESC) = 1")
def upsert_history(spark, d):
    rows = sightings(spark, d)
    return G.upsert(G.history(rows.where("document_id % 2 = 0")), rows.where("document_id % 2 = 1")).select("external_id", "observed_at", "document_id", "position", "price")


@query("append_new", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1")
def append_new(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return G.append_new(known, table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query("mark_stale", f"WITH {LISTING_SQL} SELECT is_active AND NOT coalesce(listed_at < TIMESTAMP '1998-01-01', false) AS is_active, count(*) AS n FROM listing GROUP BY 1")
def mark_stale(spark, d):
    rows = listing(spark, d).withColumn("last_seen_at", F.col("listed_at"))
    return G.mark_stale(rows, F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("is_active").agg(F.count(F.lit(1)).alias("n"))


@query("delete_source", f"WITH {LISTING_SQL}, {OBSERVATION_SQL} SELECT count(*) AS observations FROM observation WHERE listing_id NOT IN (SELECT id FROM listing WHERE source_key = 'Brand#3')")
def delete_source(spark, d):
    return G.delete_source(listing(spark, d), observation(spark, d), "Brand#3")[1].agg(F.count(F.lit(1)).alias("observations"))


@query("mark_documents", "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'PARSED' ELSE 'PENDING' END AS status, CASE WHEN o_custkey % 2 = 0 THEN 7 END AS graph_version, count(*) AS n, CAST(sum(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS attempts FROM orders GROUP BY 1, 2")
def mark_documents(spark, d):
    orders = table(spark, d, "orders")
    docs = orders.select(F.col("o_orderkey").alias("id"), F.lit("PENDING").alias("status"), F.lit(None).cast("int").alias("graph_version"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    done = orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("PARSED").alias("status"), F.lit(7).alias("graph_version"), F.lit("").alias("error"))
    return G.mark_document(docs, done).groupBy("status", "graph_version").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


@query("run_status", "SELECT CASE WHEN e = 0 THEN 'SUCCESS' WHEN s = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status, count(*) AS n FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS s FROM events GROUP BY 1) GROUP BY 1")
def run_status(spark, d):
    runs = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("stored"))
    return G.run_status(runs).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("content_hash_groups", f"WITH {LISTING_SQL} SELECT count(DISTINCT (title, description, listing_type, property_type, price, currency, price_type, area_sqm, bedrooms, bathrooms, location_name, country_code, city, district, is_active)) AS hashes FROM listing")
def content_hash_groups(spark, d):
    rows = G.content_hash(listing(spark, d), ignore=("latitude", "longitude", "listed_at", "url"))
    return rows.agg(F.countDistinct("content_hash").alias("hashes"))
