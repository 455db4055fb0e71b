"""Listing search: filters, distance, order, pages and totals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.params import EARTH_RADIUS_KM, ListingQuery, bounding_box


def haversine_km(latitude: Column, longitude: Column, lat: float, lon: float) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(a.cast("double") - F.lit(b)) / 2), 2)
    inner = half(latitude, lat) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians(latitude.cast("double"))) * half(longitude, lon)
    return 2 * F.lit(EARTH_RADIUS_KM) * F.asin(F.sqrt(inner))


def contains(column: Column, text: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` are ordinary characters."""
    return F.upper(column).contains(text.upper())


def predicate(query: ListingQuery) -> Column:
    """All filters that are set, joined by AND; null never matches. The box goes first: it reaches the scan."""
    out: list[Column] = []
    col = F.col
    if query.latitude is not None:
        box = bounding_box(query.latitude, query.longitude, query.radius_km)
        out.append(col("latitude").between(*map(F.lit, box.lat)))
        if box.lon:
            out.append(col("longitude").between(*map(F.lit, box.lon)))
    if query.text:
        out.append(contains(col("title"), query.text) | contains(col("description"), query.text))
    for name, values in (("source_key", query.source_keys), ("property_type", query.property_types), ("price_type", query.price_types)):
        if values:
            out.append(col(name).isin(list(values)))
    if query.listing_type:
        out.append(col("listing_type") == query.listing_type)
    for name in ("currency", "country_code"):
        if value := getattr(query, name):
            out.append(col(name) == value.upper())
    for name, low, high in (
        ("price", query.min_price, query.max_price), ("bedrooms", query.min_bedrooms, query.max_bedrooms), ("bathrooms", query.min_bathrooms, query.max_bathrooms),
        ("area_sqm", query.min_area, query.max_area), ("listed_at", query.listed_after, query.listed_before),
    ):
        as_type = (lambda v: F.lit(v).cast("timestamp_ntz")) if name == "listed_at" else F.lit
        out += [col(name) >= as_type(low)] * (low is not None) + [col(name) <= as_type(high)] * (high is not None)
    for name, value in (("city", query.city), ("district", query.district), ("location_name", query.location)):
        if value:
            out.append(contains(col(name), value))
    if query.is_active is not None:
        out.append(col("is_active") == query.is_active)
    for key, value in query.attributes.items():
        out.append(F.get_json_object("attributes", f"$['{key}']") == value)
    whole = F.lit(True)
    for x in out:
        whole = whole & x
    return whole


def matching(listing: DataFrame, query: ListingQuery) -> DataFrame:
    """The filtered listings, with ``distance_km`` where the query has a point."""
    found = listing.where(predicate(query))
    if query.latitude is None:
        return found
    distance = haversine_km(F.col("latitude"), F.col("longitude"), query.latitude, query.longitude)
    return found.withColumn("distance_km", distance).where(F.col("distance_km") <= query.radius_km)


def order(query: ListingQuery) -> list[Column]:
    """Ascending has nulls last, descending nulls first; the id breaks ties."""
    name, _, way = query.sort.rpartition("_")
    if query.sort == "distance":
        return [F.asc_nulls_last("distance_km"), F.asc("id")]
    return [F.asc_nulls_last(name) if way == "asc" else F.desc_nulls_first(name), F.asc("id")]


def search(listing: DataFrame, query: ListingQuery) -> DataFrame:
    """One page in order, ``rank`` from the offset. A top-k: no global sort beyond offset + limit rows."""
    found = matching(listing, query)
    top = found.orderBy(*order(query)).limit(query.offset + query.limit)
    from pyspark.sql import Window

    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order(query))))  # at most offset + limit rows
    return ranked.where(F.col("rank") > query.offset)


def total(listing: DataFrame, query: ListingQuery) -> DataFrame:
    """Exact number of matches and whether more follow the page."""
    return matching(listing, query).agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > query.offset + query.limit)


def count_by_source(listing: DataFrame) -> DataFrame:
    return listing.groupBy("source_key").agg(F.count(F.lit(1)).alias("listings"))


def after(rows: DataFrame, keys: list[str], last: list | None, limit: int) -> DataFrame:
    """Keyset page: rows after ``last`` in the ascending order of ``keys`` (not null), at most ``limit``."""
    if last is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, last, strict=True))))
    return rows.orderBy(*keys).limit(limit)


def rotation(documents: DataFrame, by: str) -> list[Column]:
    """Re-parse orders: never handled first (nulls), then the least recent by graph version or parse time."""
    first = {"graph_version": "graph_version", "parsed_at": "parsed_at"}[by]
    return [F.asc_nulls_first(first), F.asc("fetched_at"), F.asc("id")]


def select_documents(documents: DataFrame, *, source_key: str | None = None, statuses: list[str] | None = None, fetched_after=None, graph_version_below: int | None = None) -> DataFrame:
    """Documents to work on; one without a graph version is below any."""
    if source_key:
        documents = documents.where(F.col("source_key") == source_key)
    if statuses:
        documents = documents.where(F.col("status").isin(statuses))
    if fetched_after is not None:
        documents = documents.where(F.col("fetched_at") >= F.lit(fetched_after))
    if graph_version_below is not None:
        documents = documents.where((F.col("graph_version") < graph_version_below) | F.col("graph_version").isNull())
    return documents
