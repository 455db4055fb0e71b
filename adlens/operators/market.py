"""Price trends, regions and the shapes built on them."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.params import Place, TrendQuery, pool_places, region_id
from .quantiles import exact_quantiles

STEP = {"week": "7 days", "month": "1 month", "quarter": "3 months"}


def bucket(at: Column, interval: str) -> Column:
    """Start of the week (Monday), month or quarter, without a time zone."""
    return F.date_trunc(interval, at).cast("timestamp_ntz")


def money(value: Column) -> Column:
    """Two places, half up, as double; stable against the last bits of an interpolation."""
    return F.round(value.cast("double").cast("decimal(24,6)"), 2).cast("double")


def in_places(places: Sequence[Place], city: Column, district: Column) -> Column:
    """One predicate for all places, so overlaps never count a listing twice."""
    out = F.lit(False)
    whole = [p.city for p in places if p.district is None]
    if whole:
        out = out | city.isin(whole)
    by_city: dict[str, list[str]] = {}
    for p in places:
        if p.district is not None:
            by_city.setdefault(p.city, []).append(p.district)
    for name, districts in sorted(by_city.items()):
        out = out | ((city == name) & district.isin(districts))
    return F.coalesce(out, F.lit(False))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def _scoped(listing: DataFrame, observation: DataFrame, query: TrendQuery) -> DataFrame:
    homes = listing.where((F.col("country_code") == query.country_code) & (F.col("listing_type") == query.listing_type))
    if query.property_types:
        homes = homes.where(F.col("property_type").isin(list(query.property_types)))
    if query.metric == "median_price_per_sqm":
        homes = homes.where("area_sqm > 0")
    seen = observation.where((F.col("currency") == query.currency) & (F.col("price_type") == query.price_type) & (F.col("price") > 0))
    if query.date_from:
        seen = seen.where(F.col("observed_at") >= F.lit(query.date_from).cast("timestamp_ntz"))
    if query.date_to:
        seen = seen.where(F.col("observed_at") < F.lit(query.date_to).cast("timestamp_ntz"))
    homes = homes.select(F.col("id").alias("listing_id"), "city", "district", F.col("area_sqm").cast("double").alias("area"))
    return seen.join(homes, "listing_id").withColumn("bucket", bucket(F.col("observed_at"), query.interval))


def _points(rows: DataFrame, query: TrendQuery, keys: Sequence[str]) -> DataFrame:
    """A listing counts once a bucket, with its last sighting; thin buckets keep n but no value."""
    newest = [F.desc("observed_at"), F.desc("document_id"), F.desc("position")]
    once = latest(rows, [*keys, "listing_id", "bucket"], newest)
    value = F.col("price").cast("double") / F.col("area") if query.metric == "median_price_per_sqm" else F.col("price").cast("double")
    out = exact_quantiles(once.withColumn("v", value), "v", [*keys, "bucket"], (0.5, 0.25, 0.75))
    enough = F.col("n") >= query.min_samples
    return out.select(*keys, F.col("bucket").alias("period_start"), "n", *(F.when(enough, money(F.col("q")[i])).alias(name) for i, name in enumerate(("p50", "p25", "p75"))))


def price_trend(listing: DataFrame, observation: DataFrame, query: TrendQuery) -> DataFrame:
    """period_start, n, p50, p25, p75 of one region."""
    rows = _scoped(listing, observation, query)
    if query.places:
        rows = rows.where(in_places(query.places, F.col("city"), F.col("district")))
    return _points(rows, query, [])


def multi_trend(listing: DataFrame, observation: DataFrame, query: TrendQuery, regions: Mapping[str, Sequence[Place]]) -> DataFrame:
    """series, period_start, n, ...: several pooled regions over one scan. No places means everywhere."""
    rows = _scoped(listing, observation, query)
    names = []
    for name, places in regions.items():
        pooled = pool_places(tuple(places))
        hit = in_places(pooled, F.col("city"), F.col("district")) if pooled else F.lit(True)
        names.append(F.when(hit, F.lit(name)))
    rows = rows.withColumn("series", F.explode(F.array_compact(F.array(*names))))
    return _points(rows, query, ["series"])


def calendar(points: DataFrame, interval: str, keys: Sequence[str] = ("series",)) -> DataFrame:
    """Every period from the first to the last of all series; what is missing has null values and n = 0."""
    span = points.agg(F.min("period_start").alias("a"), F.max("period_start").alias("b"))
    periods = span.where("a is not null").select(F.explode(F.expr(f"sequence(a, b, interval {STEP[interval]})")).alias("period_start"))
    axis = points.select(*keys).distinct().crossJoin(F.broadcast(periods)) if keys else periods  # series times periods, both few
    return axis.join(points, [*keys, "period_start"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def summarise(points: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """First and last valued point, relative change, samples, periods without a value."""
    valued = F.col("p50").isNotNull()
    at = lambda f, c: f(F.when(valued, F.col(c)), F.when(valued, F.col("period_start")))
    out = points.groupBy(*keys).agg(
        at(F.min_by, "p50").alias("first_value"), at(F.max_by, "p50").alias("last_value"), F.min(F.when(valued, F.col("period_start"))).alias("first_period"),
        F.max(F.when(valued, F.col("period_start"))).alias("last_period"), F.sum("n").alias("samples"), F.count_if(~valued).alias("hidden"),
    )
    return out.withColumn("change", F.round(F.try_divide(F.col("last_value") - F.col("first_value"), F.col("first_value")), 6))


def regions(listing: DataFrame, observation: DataFrame, *, country_code: str | None = None, listing_type: str | None = None) -> DataFrame:
    """Listings, observations and their span by (country, city, district)."""
    homes = listing
    if country_code:
        homes = homes.where(F.col("country_code") == country_code.upper())
    if listing_type:
        homes = homes.where(F.col("listing_type") == listing_type)
    # One row a listing before the join with places: no distinct over all observations is left.
    seen = observation.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("a"), F.max("observed_at").alias("b"))
    joined = seen.join(homes.select(F.col("id").alias("listing_id"), "country_code", "city", "district"), "listing_id")
    return joined.groupBy("country_code", "city", "district").agg(
        F.count(F.lit(1)).alias("listings"), F.sum("n").alias("observations"), F.min("a").alias("first_observed_at"), F.max("b").alias("last_observed_at")
    )


def region_order() -> list[Column]:
    return [F.desc("listings"), F.asc_nulls_first("city"), F.asc_nulls_first("district")]


def cities(found: DataFrame) -> DataFrame:
    """Listings of each city, with its districts from the largest, as ``name:listings``."""
    named = F.col("district").isNotNull()
    pair = F.when(named, F.struct((-F.col("listings")).alias("neg"), F.col("district").alias("name")))
    return found.where("city is not null").groupBy("city").agg(F.sum("listings").alias("listings"), F.array_sort(F.collect_list(pair)).alias("d")).select(
        "city", "listings", F.array_join(F.transform("d", lambda x: F.concat(x["name"], F.lit(":"), (-x["neg"]).cast("string"))), ",").alias("districts")
    )


def data_span(found: DataFrame, places: Sequence[Place]) -> DataFrame:
    """First and last observation over the regions that ``places`` cover, over all where they cover none."""
    inside = in_places(places, F.col("city"), F.col("district")) if places else F.lit(True)
    over = lambda f, c: F.coalesce(f(F.when(inside, F.col(c))), f(c))
    return found.agg(over(F.min, "first_observed_at").alias("first_observed_at"), over(F.max, "last_observed_at").alias("last_observed_at"))


__all__ = ["price_trend", "multi_trend", "calendar", "summarise", "regions", "cities", "data_span", "region_id"]
