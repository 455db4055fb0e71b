"""Parameters, trends, search, merge and queue on hand-made cases."""
import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from adlens.operators import frontier as Q
from adlens.operators import market as M
from adlens.operators import merge as G
from adlens.operators import search as S
from adlens.plans.params import ListingQuery, Place, TrendQuery, bounding_box, parse_place, pool_places, region_id, years_before


def test_places():
    assert parse_place("Cairo/New Cairo/5th") == Place("Cairo", "New Cairo/5th")
    assert parse_place(" Giza ") == Place("Giza")
    assert pool_places([Place("Cairo"), Place("Cairo", "Maadi"), Place("Giza", "Dokki"), Place("Cairo")]) == (Place("Cairo"), Place("Giza", "Dokki"))
    assert region_id([Place("b"), Place("a", "x")]) == region_id([Place("a", "x"), Place("b")])
    with pytest.raises(ValueError):
        parse_place("/x")


def test_dates():
    assert years_before(date(2024, 2, 29), 25) == date(1999, 2, 28)
    assert TrendQuery.day_range(date(2024, 1, 1), date(2024, 1, 31), date(2030, 1, 1)) == (datetime(2024, 1, 1), datetime(2024, 2, 1))


@pytest.mark.parametrize("bad", [{"latitude": 1.0}, {"sort": "distance"}, {"min_price": 2, "max_price": 1}, {"limit": 101}, {"limit": 0}, {"radius_km": 501, "latitude": 0, "longitude": 0}, {"nonsense": 1}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        ListingQuery.of(bad)


def test_box_is_a_superset():
    from math import asin, cos, degrees, radians, sin

    for lat in (-80.0, -33.3, 0.0, 30.05, 66.6):
        box = bounding_box(lat, 31.2, 120.0)
        for bearing in range(0, 360, 15):
            d = 119.999 / 6371.0088
            y = asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(bearing)))
            x = radians(31.2) + __import__("math").atan2(sin(radians(bearing)) * sin(d) * cos(radians(lat)), cos(d) - sin(radians(lat)) * sin(y))
            assert float(box.lat[0]) <= degrees(y) <= float(box.lat[1])
            assert box.lon is None or float(box.lon[0]) <= degrees(x) <= float(box.lon[1])
    assert bounding_box(89.9, 0, 100).lon is None and bounding_box(0, 179.9, 100).lon is None


def seed(spark, rows, homes):
    listing = spark.createDataFrame(homes, "id long, country_code string, listing_type string, property_type string, city string, district string, area_sqm double")
    obs = spark.createDataFrame([(i, t, p, "EGP", "PER_MONTH", n, 0) for n, (i, t, p) in enumerate(rows)], "listing_id long, observed_at timestamp_ntz, price double, currency string, price_type string, document_id long, position int")
    return listing, obs


def test_trend_counts_a_listing_once(spark):
    listing, obs = seed(spark, [(1, datetime(2024, 1, 1), 100.0), (1, datetime(2024, 1, 6), 300.0), (1, datetime(2024, 2, 1), 500.0), (2, datetime(2024, 1, 2), 200.0)], [(i, "EG", "RENT", "APARTMENT", "Cairo", "Maadi", 50.0) for i in (1, 2)])
    got = [(r.period_start.month, r.n, r.p50) for r in M.price_trend(listing, obs, TrendQuery("eg", "RENT", "egp")).orderBy("period_start").collect()]
    assert got == [(1, 2, 250.0), (2, 1, 500.0)]
    thin = M.price_trend(listing, obs, TrendQuery("EG", "RENT", "EGP", min_samples=2)).orderBy("period_start").collect()
    assert [(r.n, r.p50) for r in thin] == [(2, 250.0), (1, None)]


def test_trend_per_sqm_and_places(spark):
    homes = [(1, "EG", "RENT", "A", "Cairo", "Maadi", 50.0), (2, "EG", "RENT", "A", "Cairo", "Zamalek", 100.0), (3, "EG", "RENT", "A", "Cairo", None, None), (4, "EG", "RENT", "A", "Giza", "Dokki", 10.0)]
    listing, obs = seed(spark, [(1, datetime(2024, 1, 1), 1000.0), (2, datetime(2024, 1, 1), 5000.0), (3, datetime(2024, 1, 1), 9.0), (4, datetime(2024, 1, 1), 7.0)], homes)
    pool = (Place("Cairo"), Place("Cairo", "Maadi"))
    assert M.price_trend(listing, obs, TrendQuery("EG", "RENT", "EGP", metric="median_price_per_sqm", places=pool)).first().p50 == 35.0
    assert M.price_trend(listing, obs, TrendQuery("EG", "RENT", "EGP", places=(Place("Giza", "Maadi"),))).count() == 0
    assert M.price_trend(listing, obs, TrendQuery("EG", "RENT", "EGP", places=pool)).first().n == 3


def test_search_order_and_pages(spark):
    rows = [(i, f"t{i}", None if i % 3 == 0 else float(i % 4)) for i in range(1, 20)]
    base = spark.createDataFrame(rows, "id long, title string, price double").withColumns({"description": F.lit(None).cast("string"), "is_active": F.lit(True), "listed_at": F.lit(None).cast("timestamp_ntz")})
    seen = [r.id for o in range(0, 20, 5) for r in S.search(base, ListingQuery(sort="price_asc", limit=5, offset=o)).orderBy("rank").collect()]
    assert seen == [i for i, _, _ in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))]
    down = [r.id for r in S.search(base, ListingQuery(sort="price_desc", limit=6)).orderBy("rank").collect()]
    assert down == [3, 6, 9, 12, 15, 18]
    assert S.total(base, ListingQuery(text="T1")).first().total == 11


SIGHT = "source_key string, external_id string, observed_at timestamp_ntz, document_id long, position int, historical boolean, bedrooms int, price double, location_name string, content_hash string"


def fold(rows):
    """The rule one sighting at a time."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        old = out.get(r[1])
        new = {"bedrooms": r[6], "price": r[7], "location_name": r[8]}
        if old and r[5]:
            new["bedrooms"] = old["bedrooms"] if r[6] is None else r[6]
            new["location_name"] = old["location_name"] if r[8] == "unknown" else r[8]
        out[r[1]] = new
    return out


def test_rebuild_is_a_fold_and_ignores_arrival(spark):
    rng = random.Random(3)
    rows = [("s", str(rng.randrange(40)), datetime(2020, 1, 1) + timedelta(days=rng.randrange(60)), i, 0, rng.random() > 0.15, rng.choice([None, 1, 2]), float(rng.randrange(9)), rng.choice(["unknown", "a", "b"]), rng.choice("xy")) for i in range(500)]
    kept = {(r[1], r[2]): r for r in sorted(rows, key=lambda r: r[3])}  # at one moment the later document
    want = fold(kept.values())
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for some in (rows, shuffled):
        half = len(some) // 2
        first, second = (spark.createDataFrame(x, SIGHT) for x in (some[:half], some[half:]))
        got = {r.external_id: {"bedrooms": r.bedrooms, "price": r.price, "location_name": r.location_name} for r in G.rebuild(G.upsert(G.history(first), second)).collect()}
        assert got == want


def test_live_records_changes_only(spark):
    t = datetime(2024, 1, 1)
    rows = [("s", "1", t + timedelta(days=i), i, 0, False, 1, 1.0, "a", h) for i, h in enumerate("xxyyx")]
    assert [r.change for r in G.observation_policy(spark.createDataFrame(rows, SIGHT)).orderBy("observed_at").collect()] == ["created", "updated", "updated"]


def stratified(rows, served, taken, cap):
    """The rule over lists."""
    month, quarter = (lambda t: t[:6]), (lambda t: f"{t[:4]}Q{(int(t[4:6]) - 1) // 3 + 1}")
    per_q = defaultdict(int)
    for m, n in served.items():
        per_q[quarter(m)] += n
    groups, by_q, out = defaultdict(list), defaultdict(list), []
    for i, t, p in rows:
        groups[p, month(t)].append(((i * 0x9E3779B97F4A7C15) % 2**64, i))
    for (p, m), ids in groups.items():
        by_q[quarter(m)] += [(-p, served.get(m, 0) + k, m, d, i) for k, (d, i) in enumerate(sorted(ids))]
    for q, xs in by_q.items():
        xs.sort()
        xs = xs if cap is None else xs[: max(0, cap - taken.get(q, 0))]
        out += [(per_q[q] + k, x[0], q, x[4]) for k, x in enumerate(xs)]
    return [x[3] for x in sorted(out)]


@pytest.mark.parametrize("cap", [None, 12])
def test_stratified_order(spark, cap):
    rng = random.Random(5)
    t = lambda: f"20{rng.randrange(10, 13)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}"
    rows = [(i, t(), rng.randrange(3)) for i in range(300)]
    past = [(t(), rng.choice(["FETCHED", "FETCHING", "FAILED"])) for _ in range(60)]
    served, taken = defaultdict(int), defaultdict(int)
    for ts, s in past:
        served[ts[:6]] += 1
        taken[f"{ts[:4]}Q{(int(ts[4:6]) - 1) // 3 + 1}"] += s != "FAILED"
    got = Q.stratified_order(spark.createDataFrame(rows, "id long, timestamp string, priority int"), spark.createDataFrame(past, "timestamp string, status string"), cap)
    assert [r.id for r in got.orderBy("rank").collect()] == stratified(rows, served, taken, cap)


def test_timestamps(spark):
    row = spark.createDataFrame([("20131027",), ("2013",), ("20130305032637",)], "t string").select(Q.capture_quarter(F.col("t")).alias("q"), Q.captured_at(F.col("t")).alias("at")).collect()
    assert [r.q for r in row] == ["2013Q4", "2013Q1", "2013Q1"]
    assert [r.at for r in row] == [datetime(2013, 10, 27), datetime(2013, 1, 1), datetime(2013, 3, 5, 3, 26, 37)]


def test_rebuild_sorts_once(spark):
    rows = spark.createDataFrame(
        [("s", "a", datetime(2020, 1, n), n, 0, b, w, h) for n, b, w, h in ((1, 2, "x", True), (2, None, "unknown", True), (3, None, "unknown", False), (4, None, "unknown", True))]
        + [("s", "b", datetime(2020, 1, n), n, 0, b, w, True) for n, b, w in ((1, 2, "x"), (2, None, "unknown"))],
        "source_key string, external_id string, observed_at timestamp_ntz, document_id long, position int, bedrooms long, location_name string, historical boolean",
    )
    out = G.rebuild(rows)
    got = {r.external_id: (r.bedrooms, r.location_name, r.sightings, r.provenance, r.first_observed_at.day, r.last_observed_at.day) for r in out.collect()}
    assert got == {"a": (None, "unknown", 4, "", 1, 4), "b": (2, "x", 2, "bedrooms=1", 1, 2)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count(" Sort [") <= 1, plan


def test_a_released_tree_has_no_ties():
    from adlens.functions import html as H

    root = H.parse("<html><body><p>a</p></body></html>")
    node = next(iter(H.select(root, "p")))
    H.release(root)
    assert node.parent is None and not root.children
