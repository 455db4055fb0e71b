"""The listing model over the star schema's tables, so that every operator runs on them.

listing: one row a part. observation: one row a lineitem. frontier: events, or orders for several years.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", F.col("n_name").alias("district"), F.col("r_name").alias("city"))  # 25 rows
    rent = k % 3 == 0
    return table(spark, sf_dir, "part").join(F.broadcast(places), (k % 25).cast("int") == F.col("n_nationkey")).select(
        k.alias("id"), F.col("p_brand").alias("source_key"), F.concat(F.lit("P"), k.cast("string")).alias("external_id"),
        F.col("p_name").alias("title"), F.when(k % 5 != 0, F.concat_ws(" ", "p_type", "p_name")).alias("description"),
        F.when(rent, "RENT").otherwise("SALE").alias("listing_type"), F.col("p_type").alias("property_type"),
        F.col("p_retailprice").cast("decimal(14,2)").alias("price"), F.when(k % 4 == 0, "USD").otherwise("EGP").alias("currency"),
        F.when(k % 9 == 0, "UNKNOWN").when(rent, "PER_MONTH").otherwise("TOTAL").alias("price_type"),
        F.when(k % 17 != 0, F.col("p_size")).cast("decimal(12,2)").alias("area_sqm"),
        (F.col("p_size") % 6).cast("short").alias("bedrooms"), (F.col("p_size") % 4).cast("short").alias("bathrooms"),
        F.concat_ws(", ", "district", "city").alias("location_name"), F.lit("EG").alias("country_code"), "city",
        F.when(k % 19 != 0, F.col("district")).alias("district"),
        F.when(k % 11 != 0, F.lit(25) + (k * 37 % 1000) / F.lit(100)).cast("decimal(9,6)").alias("latitude"),
        F.when(k % 11 != 0, F.lit(27) + (k * 91 % 1000) / F.lit(100)).cast("decimal(9,6)").alias("longitude"),
        (k % 7 != 0).alias("is_active"),
        F.when(k % 13 != 0, F.timestamp_add("DAY", (k % 2000).cast("int"), F.lit("1995-01-01").cast("timestamp_ntz"))).alias("listed_at"),
    )


def observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("listing_id"), F.col("l_shipdate").alias("observed_at"), F.col("l_extendedprice").cast("decimal(14,2)").alias("price"),
        F.when(F.col("l_linestatus") == "O", "EGP").otherwise("USD").alias("currency"),
        F.when(F.col("l_returnflag") == "N", "TOTAL").when(F.col("l_returnflag") == "A", "PER_MONTH").otherwise("UNKNOWN").alias("price_type"),
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("position"),
    )


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures over several years, from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("orders").alias("source_key"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url_key"),
        F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "F", "FETCHED").otherwise("FAILED").alias("status"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.md5(F.col("o_totalprice").cast("string")).alias("digest"),
    )


#: The same views in DuckDB's SQL, for the oracles.
LISTING_SQL = """
  listing AS (SELECT p_partkey AS id, p_brand AS source_key, 'P' || p_partkey AS external_id, p_name AS title,
    CASE WHEN p_partkey % 5 <> 0 THEN p_type || ' ' || p_name END AS description, CASE WHEN p_partkey % 3 = 0 THEN 'RENT' ELSE 'SALE' END AS listing_type,
    p_type AS property_type, CAST(p_retailprice AS DECIMAL(14,2)) AS price, CASE WHEN p_partkey % 4 = 0 THEN 'USD' ELSE 'EGP' END AS currency,
    CASE WHEN p_partkey % 9 = 0 THEN 'UNKNOWN' WHEN p_partkey % 3 = 0 THEN 'PER_MONTH' ELSE 'TOTAL' END AS price_type,
    CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size AS DECIMAL(12,2)) END AS area_sqm, p_size % 6 AS bedrooms, p_size % 4 AS bathrooms,
    n_name || ', ' || r_name AS location_name, 'EG' AS country_code, r_name AS city, CASE WHEN p_partkey % 19 <> 0 THEN n_name END AS district,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(25 + (p_partkey * 37 % 1000) / 100.0 AS DECIMAL(9,6)) END AS latitude,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(27 + (p_partkey * 91 % 1000) / 100.0 AS DECIMAL(9,6)) END AS longitude,
    p_partkey % 7 <> 0 AS is_active, CASE WHEN p_partkey % 13 <> 0 THEN TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 2000 AS INTEGER)) END AS listed_at
    FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON n_regionkey = r_regionkey)"""
OBSERVATION_SQL = """
  observation AS (SELECT l_partkey AS listing_id, l_shipdate AS observed_at, CAST(l_extendedprice AS DECIMAL(14,2)) AS price,
    CASE WHEN l_linestatus = 'O' THEN 'EGP' ELSE 'USD' END AS currency,
    CASE l_returnflag WHEN 'N' THEN 'TOTAL' WHEN 'A' THEN 'PER_MONTH' ELSE 'UNKNOWN' END AS price_type, l_orderkey AS document_id, l_linenumber AS position FROM lineitem)"""
FRONTIER_SQL = """
  frontier AS (SELECT o_orderkey AS id, 'orders' AS source_key, 'u' || o_custkey AS url_key, strftime(o_orderdate, '%Y%m%d%H%M%S') AS timestamp,
    CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'F' THEN 'FETCHED' ELSE 'FAILED' END AS status,
    6 - CAST(o_orderpriority[1] AS INTEGER) AS priority, md5(CAST(o_totalprice AS VARCHAR)) AS digest FROM orders)"""
