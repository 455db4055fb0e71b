"""Claims that become payloads: outcomes, retries, budgets, claims that are lost."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from adlens.operators import frontier as Q
from adlens.operators import replay as R
from adlens.sources.staging import Stage
from adlens.sources.versions import VersionedTable

NOW = datetime(2024, 1, 1)
QUEUE = "id long, url_key string, original_url string, timestamp string, priority int, status string, attempts int, next_retry_at timestamp_ntz, claimed_at timestamp_ntz, claimed_by string"
REPLAYS = "replay_id long, url_key string, timestamp string, original_url string"


def row(i, key="k", url="http://shop.example/k", at="20120601000000", status="QUEUED", attempts=0):
    return (i, key, url, at, 1, status, attempts, None, None, None)


@pytest.fixture()
def queue(spark, tmp_path):
    def make(rows):
        df = spark.createDataFrame(rows, QUEUE)
        out = VersionedTable(spark, str(tmp_path / "q"), df.schema, ["id"], buckets=2)
        out.update(lambda _: df, lambda old, new: new)
        return out

    return make


def replays(spark):
    return spark.createDataFrame([
        (1, "k", "20120531000000", "http://www.shop.example/k"), (2, "k", "20120602000000", "http://shop.example/k"), (3, "far", "20190101000000", "http://shop.example/far"),
        (4, "led", "20120601000000", "http://elsewhere.example/"), (5, "sub", "201206", "http://m.shop.example/s"), (6, "k", None, "http://shop.example/k"), (7, None, "20120601000000", None), (8, "k", "20120602000000", "http://shop.example/k"),
    ], REPLAYS)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_outcomes(spark):
    claimed = spark.createDataFrame([
        row(1), row(2, "far"), row(3, "led"), row(4, "nothing"), row(5, url="http://notshop.example/k"), row(6, "sub", "http://m.shop.example/s"), row(7, at=None), row(8, None, None), row(9, at="20120602"),
    ], QUEUE)
    got = {r.id: (r.outcome, r.problem, r.replay_id, r.drift_s) for r in R.payloads(claimed, replays(spark), "shop.example", (2010, 2015)).collect()}
    assert got == {
        1: ("FETCHED", None, 1, -86400), 2: ("FAILED", "served from outside the years", 3, 207792000), 3: ("FAILED", "another site was served", 4, 0), 4: ("RETRY", "nothing is stored", None, None),
        5: ("FAILED", "another site was asked for", 1, -86400), 6: ("FAILED", "another site was asked for", 5, 0), 7: ("RETRY", "nothing is stored", None, None), 8: ("FAILED", "another site was asked for", None, None), 9: ("FETCHED", None, 2, 0),
    }
    wide = R.payloads(claimed, replays(spark), "shop.example", (2010, 2015), subdomains=True).where("id = 6").first()
    assert (wide.outcome, wide.replay_id) == ("FETCHED", 5)
    assert R.payloads(claimed, replays(spark).limit(0), "shop.example", (2010, 2015)).where("outcome = 'FETCHED'").count() == 0


def test_fetch_spends_its_budget_and_settles(spark, queue):
    held = queue([row(i) for i in range(1, 6)] + [row(10, "nothing"), row(11, "nothing", attempts=2), row(12, "led"), row(13, status="FETCHED")])
    stage = Stage(spark)
    first = R.fetch(held, replays(spark), stage, now(), "a", budget=3, batch=2, domain="shop.example", years=(2010, 2015))
    assert first.count() == 3 and held.read().where("status = 'QUEUED' and next_retry_at is null").count() == 5
    rest = R.fetch(held, replays(spark), stage, now(), "b", budget=50, batch=2, domain="shop.example", years=(2010, 2015))
    assert sorted(r.id for r in first.unionAll(rest).collect()) == [1, 2, 3, 4, 5, 10, 11, 12]  # each once: what waits isn't tried again
    after = {r.id: (r.status, r.attempts, r.next_retry_at, r.claimed_by) for r in held.read().collect()}
    assert all(after[i] == ("FETCHED", 0, None, None) for i in range(1, 6)) and after[13] == ("FETCHED", 0, None, None)
    assert after[10] == ("QUEUED", 1, datetime(2024, 1, 1, 0, 10), None)
    assert after[11] == ("FAILED", 3, None, None) and after[12] == ("FAILED", 1, None, None)
    assert R.fetch(held, replays(spark), stage, now(), "c", budget=5, domain="shop.example", years=(2010, 2015)).count() == 0
    stage.drop()


def test_a_claim_that_went_to_another_worker_stays_there(spark, queue):
    held = queue([row(1)])
    old = Q.claim_from(held, now(), 1, "slow").select("id", "claimed_by").collect()
    held.update(lambda t: Q.release_stale(t, F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")).select(*t.columns), lambda old, new: new)
    Q.claim_from(held, F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz"), 1, "quick")
    R.settle(held, spark.createDataFrame([(*r, "FETCHED") for r in old], "id long, claimed_by string, outcome string"), now())
    assert (held.read().first().status, held.read().first().claimed_by[:5]) == ("FETCHING", "quick")
