"""Search queries."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.views import LISTING_SQL, listing, table
from .params import ListingQuery, bounding_box
from .registry import query

_V = f"WITH {LISTING_SQL}"
SHOWN = ["rank", "id", "title", "price", "listed_at"]


def _page(where: str, order: str, limit: int, offset: int, extra: str = "") -> str:
    return f"""{_V}, ranked AS (SELECT row_number() OVER (ORDER BY {order}) AS rank, id, title, CAST(price AS DOUBLE) AS price, listed_at{extra} FROM listing WHERE {where})
      SELECT * FROM ranked WHERE rank > {offset} AND rank <= {offset + limit}"""


def _show(df, *extra):
    return df.select(F.col("rank").cast("long").alias("rank"), "id", "title", F.col("price").cast("double").alias("price"), "listed_at", *extra)


def _search(q: ListingQuery, *extra: str):
    return lambda spark, d: _show(S.search(listing(spark, d), q), *map(F.expr, extra))


_ACTIVE = "is_active"
query("search_default", _page(_ACTIVE, "listed_at DESC NULLS FIRST, id", 20, 0))(_search(ListingQuery()))
query("search_text_page2", _page(f"{_ACTIVE} AND (contains(upper(title), 'RING') OR contains(upper(description), 'RING'))", "price ASC NULLS LAST, id", 15, 15))(
    _search(ListingQuery(text="ring", sort="price_asc", limit=15, offset=15))
)
query(
    "search_filters",
    _page(
        f"{_ACTIVE} AND source_key IN ('Brand#1','Brand#2','Brand#3') AND listing_type = 'SALE' AND property_type IN ('PROMO','SMALL','LARGE') AND price_type IN ('TOTAL') AND currency = 'EGP' AND country_code = 'EG'"
        " AND price >= 905 AND price <= 1800 AND bedrooms >= 1 AND bedrooms <= 4 AND bathrooms >= 0 AND bathrooms <= 3 AND area_sqm >= 3 AND area_sqm <= 45"
        " AND contains(upper(city), 'A') AND contains(upper(district), 'NATION') AND contains(upper(location_name), ', ')"
        " AND listed_at >= TIMESTAMP '1995-02-01' AND listed_at <= TIMESTAMP '2000-06-01'",
        "price DESC NULLS FIRST, id", 50, 0,
    ),
)(
    _search(ListingQuery(
        source_keys=("Brand#1", "Brand#2", "Brand#3"), listing_type="SALE", property_types=("PROMO", "SMALL", "LARGE"), price_types=("TOTAL",), currency="egp", country_code="eg",
        min_price=905, max_price=1800, min_bedrooms=1, max_bedrooms=4, min_bathrooms=0, max_bathrooms=3, min_area=3, max_area=45, city="a", district="nation", location=", ",
        listed_after=datetime(1995, 2, 1), listed_before=datetime(2000, 6, 1), sort="price_desc", limit=50,
    ))
)
query("search_inactive_any", _page("contains(upper(title), '%')" + " OR is_active IN (true, false)", "listed_at ASC NULLS LAST, id", 10, 0))(_search(ListingQuery(is_active=None, sort="listed_at_asc", limit=10)))

LAT, LON, KM = 30.05, 31.24, 250.0
_BOX = bounding_box(LAT, LON, KM)
_DIST = f"(2 * 6371.0088 * asin(sqrt(pow(sin(radians(CAST(latitude AS DOUBLE) - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(CAST(latitude AS DOUBLE))) * pow(sin(radians(CAST(longitude AS DOUBLE) - {LON}) / 2), 2))))"
_GEO = ListingQuery(latitude=LAT, longitude=LON, radius_km=KM, sort="distance", limit=40)
query("search_radius", _page(f"{_ACTIVE} AND {_DIST} <= {KM}", f"{_DIST} ASC, id", 40, 0, f", round({_DIST}, 6) AS distance_km"))(_search(_GEO, "round(distance_km, 6) AS distance_km"))


@query("search_radius_total", f"{_V} SELECT count(*) AS total, count(*) > 40 AS has_more FROM listing WHERE {_ACTIVE} AND {_DIST} <= {KM}")
def search_radius_total(spark, d):
    return S.total(listing(spark, d), _GEO)


@query("listing_box", f"{_V} SELECT count(*) AS n FROM listing WHERE latitude BETWEEN {_BOX.lat[0]} AND {_BOX.lat[1]} AND longitude BETWEEN {_BOX.lon[0]} AND {_BOX.lon[1]}")
def listing_box(spark, d):
    return listing(spark, d).where(F.col("latitude").between(*map(F.lit, _BOX.lat)) & F.col("longitude").between(*map(F.lit, _BOX.lon))).agg(F.count(F.lit(1)).alias("n"))


@query("count_by_source", f"{_V} SELECT source_key, count(*) AS listings FROM listing GROUP BY 1")
def count_by_source(spark, d):
    return S.count_by_source(listing(spark, d))


@query("keyset_page", "SELECT o_orderkey AS id, o_orderdate AS fetched_at FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-03-04', 500) ORDER BY o_orderdate, o_orderkey LIMIT 60")
def keyset_page(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("fetched_at"))
    return S.after(docs, ["fetched_at", "id"], [datetime(1997, 3, 4), 500], 60).select("id", "fetched_at")


_DOCS_SQL = """docs AS (SELECT o_orderkey AS id, o_orderdate AS fetched_at, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'PARSED' ELSE 'FAILED' END AS status,
  CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 10 END AS graph_version FROM orders)"""


def _docs(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit("orders").alias("source_key"), F.col("o_orderdate").alias("fetched_at"),
        F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "PARSED").otherwise("FAILED").alias("status"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 10).alias("graph_version"),
    )


@query("documents_stale", f"WITH {_DOCS_SQL} SELECT id, graph_version FROM docs WHERE status IN ('PARSED', 'FAILED') AND fetched_at >= TIMESTAMP '1998-01-01' AND (graph_version < 5 OR graph_version IS NULL)")
def documents_stale(spark, d):
    return S.select_documents(_docs(spark, d), source_key="orders", statuses=["PARSED", "FAILED"], fetched_after=datetime(1998, 1, 1), graph_version_below=5).select("id", "graph_version")


@query("documents_rotation", f"WITH {_DOCS_SQL} SELECT row_number() OVER (ORDER BY graph_version ASC NULLS FIRST, fetched_at, id) AS rank, id FROM docs QUALIFY rank <= 100")
def documents_rotation(spark, d):
    from pyspark.sql import Window

    order = S.rotation(None, "graph_version")
    top = _docs(spark, d).orderBy(*order).limit(100)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "id")


@query("documents_rotation_parsed", f"WITH {_DOCS_SQL}, p AS (SELECT *, CASE WHEN id % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(id % 100 AS INTEGER)) END AS parsed_at FROM docs) SELECT id FROM p WHERE status = 'PARSED' ORDER BY parsed_at ASC NULLS FIRST, fetched_at, id LIMIT 100")
def documents_rotation_parsed(spark, d):
    k = F.col("id")
    parsed = F.when(k % 4 != 0, F.timestamp_add("DAY", (k % 100).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))
    docs = S.select_documents(_docs(spark, d), statuses=["PARSED"]).withColumn("parsed_at", parsed)
    return docs.orderBy(*S.rotation(docs, "parsed_at")).limit(100).select("id")
