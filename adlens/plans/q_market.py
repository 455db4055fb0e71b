"""Market queries: trends, regions, series."""
from __future__ import annotations

from datetime import datetime

from ..operators import market as M
from ..sources.views import LISTING_SQL, OBSERVATION_SQL, listing, observation
from .params import Place, TrendQuery
from .registry import query

_VIEWS = f"WITH {LISTING_SQL}, {OBSERVATION_SQL}"


def _money(p: float) -> str:
    return f"CAST(round(CAST(quantile_cont(CAST(v AS DOUBLE), {p}) AS DECIMAL(24,6)), 2) AS DOUBLE)"


def _trend_sql(interval: str, where: str, value: str = "CAST(price AS DOUBLE)", least: int = 1, tail: str = "") -> str:
    points = ", ".join(f"CASE WHEN count(*) >= {least} THEN {_money(p)} END AS {n}" for n, p in (("p50", 0.5), ("p25", 0.25), ("p75", 0.75)))
    return f"""{_VIEWS}, latest AS (
      SELECT listing_id, date_trunc('{interval}', observed_at) AS bucket, {value} AS v,
        row_number() OVER (PARTITION BY listing_id, date_trunc('{interval}', observed_at) ORDER BY observed_at DESC, document_id DESC, position DESC) AS rn
      FROM (SELECT o.*, l.area_sqm, l.city, l.district, l.property_type FROM observation o JOIN listing l ON l.id = o.listing_id
            WHERE o.price > 0 AND l.country_code = 'EG' AND {where}))
      SELECT CAST(bucket AS TIMESTAMP) AS period_start, count(*) AS n, {points} FROM latest WHERE rn = 1 GROUP BY bucket {tail}"""


_SALE = "l.listing_type = 'SALE' AND o.price_type = 'TOTAL' AND o.currency = 'EGP'"
_RENT = "l.listing_type = 'RENT' AND o.price_type = 'PER_MONTH' AND o.currency = 'USD'"
PLACES = (Place("AFRICA"), Place("AFRICA", "NATION_0"), Place("ASIA", "NATION_7"), Place("EUROPE", "NATION_2"))


def _run(q: TrendQuery):
    return lambda spark, d: M.price_trend(listing(spark, d), observation(spark, d), q)


for _interval in ("week", "month", "quarter"):
    query(f"price_trend_{_interval}", _trend_sql(_interval, _SALE))(_run(TrendQuery("EG", "SALE", "EGP", _interval)))
query("price_trend_per_sqm", _trend_sql("month", _SALE + " AND l.area_sqm > 0", "CAST(price AS DOUBLE) / CAST(area_sqm AS DOUBLE)"))(
    _run(TrendQuery("EG", "SALE", "EGP", metric="median_price_per_sqm"))
)
query("price_trend_rent_min_samples", _trend_sql("week", _RENT, least=4))(_run(TrendQuery("EG", "RENT", "USD", "week", min_samples=4)))
query(
    "price_trend_places",
    _trend_sql("quarter", _SALE + " AND (l.city = 'AFRICA' OR (l.city = 'ASIA' AND l.district = 'NATION_7') OR (l.city = 'EUROPE' AND l.district = 'NATION_2')) AND l.property_type IN ('PROMO','SMALL') AND o.observed_at >= TIMESTAMP '1996-01-01' AND o.observed_at < TIMESTAMP '2000-03-01'"),
)(_run(TrendQuery("EG", "SALE", "EGP", "quarter", places=PLACES, property_types=("PROMO", "SMALL"), date_from=datetime(1996, 1, 1), date_to=datetime(2000, 3, 1))))

REGIONS = {"north": (Place("EUROPE"), Place("AMERICA")), "south": (Place("AFRICA"), Place("EUROPE", "NATION_3")), "all": ()}
_MULTI = f"""{_VIEWS}, series(series, city, district) AS (VALUES ('north', 'EUROPE', NULL), ('north', 'AMERICA', NULL), ('south', 'AFRICA', NULL), ('south', 'EUROPE', 'NATION_3')),
  hit AS (SELECT DISTINCT s.series, l.id FROM listing l JOIN series s ON l.city = s.city AND (s.district IS NULL OR l.district = s.district) UNION ALL SELECT 'all', id FROM listing),
  latest AS (SELECT h.series, o.listing_id, date_trunc('quarter', observed_at) AS bucket, CAST(o.price AS DOUBLE) AS v,
    row_number() OVER (PARTITION BY h.series, o.listing_id, date_trunc('quarter', observed_at) ORDER BY observed_at DESC, document_id DESC, position DESC) AS rn
    FROM observation o JOIN listing l ON l.id = o.listing_id JOIN hit h ON h.id = l.id WHERE o.price > 0 AND {_SALE}),
  points AS (SELECT series, CAST(bucket AS TIMESTAMP) AS period_start, count(*) AS n, {_money(0.5)} AS p50, {_money(0.25)} AS p25, {_money(0.75)} AS p75 FROM latest WHERE rn = 1 GROUP BY series, bucket)"""


def _multi(spark, d):
    return M.multi_trend(listing(spark, d), observation(spark, d), TrendQuery("EG", "SALE", "EGP", "quarter"), REGIONS)


query("multi_trend", _MULTI + " SELECT * FROM points")(_multi)


@query(
    "series_calendar",
    _MULTI + """, axis AS (SELECT DISTINCT s.series, CAST(p AS TIMESTAMP) AS period_start FROM (SELECT DISTINCT series FROM points) s,
      (SELECT unnest(generate_series(min(period_start), max(period_start), INTERVAL 3 MONTH)) AS p FROM points))
      SELECT a.series, a.period_start, coalesce(n, 0) AS n, p50, p25, p75 FROM axis a LEFT JOIN points USING (series, period_start)""",
)
def series_calendar(spark, d):
    return M.calendar(_multi(spark, d), "quarter")


@query(
    "series_summary",
    _MULTI + """, s AS (SELECT series, min_by(p50, period_start) AS first_value, max_by(p50, period_start) AS last_value, min(period_start) AS first_period, max(period_start) AS last_period,
      CAST(sum(n) AS BIGINT) AS samples, CAST(0 AS BIGINT) AS hidden FROM points GROUP BY series)
      SELECT *, round((last_value - first_value) / first_value, 6) AS change FROM s""",
)
def series_summary(spark, d):
    return M.summarise(_multi(spark, d))


_REGIONS = f"""{_VIEWS}, regions AS (SELECT country_code, city, district, count(DISTINCT l.id) AS listings, count(*) AS observations, min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at
  FROM observation o JOIN listing l ON l.id = o.listing_id WHERE l.listing_type = 'SALE' GROUP BY ALL)"""


def _regions(spark, d):
    return M.regions(listing(spark, d), observation(spark, d), country_code="eg", listing_type="SALE")


query("regions", _REGIONS + " SELECT * FROM regions")(_regions)


@query("region_cities", _REGIONS + " SELECT city, CAST(sum(listings) AS BIGINT) AS listings, string_agg(district || ':' || listings, ',' ORDER BY listings DESC, district) FILTER (WHERE district IS NOT NULL) AS districts FROM regions GROUP BY city")
def region_cities(spark, d):
    return M.cities(_regions(spark, d))


@query("region_span", _REGIONS + " SELECT min(first_observed_at) AS first_observed_at, max(last_observed_at) AS last_observed_at FROM regions WHERE city = 'AFRICA' OR (city = 'ASIA' AND district = 'NATION_7') OR (city = 'EUROPE' AND district = 'NATION_2')")
def region_span(spark, d):
    return M.data_span(_regions(spark, d), PLACES)
