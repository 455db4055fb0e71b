"""Frontier queries: captures are orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier as Q
from ..sources.views import FRONTIER_SQL, frontier, table
from .registry import query

_V = f"WITH {FRONTIER_SQL}"
_MONTH = "substr(timestamp, 1, 6)"
_QUARTER = "(substr(timestamp, 1, 4) || 'Q' || ((CAST(substr(timestamp, 5, 2) AS INTEGER) - 1) // 3 + 1))"
_DRAW = "(CAST(id AS HUGEINT) * 11400714819323198485) % 18446744073709551616"


def _order_sql(served: bool, cap: int | None) -> str:
    past = "FETCHED', 'FAILED" if served else ""
    return f"""{_V}, q AS (SELECT id, priority, {_MONTH} AS month, {_QUARTER} AS quarter, {_DRAW} AS draw FROM frontier WHERE status = 'QUEUED'),
      ms AS (SELECT {_MONTH} AS month, count(*) AS s FROM frontier WHERE status IN ('{past}') GROUP BY 1),
      qs AS (SELECT {_QUARTER} AS quarter, count(*) AS s, count(*) FILTER (status = 'FETCHED') AS t FROM frontier WHERE status IN ('{past}') GROUP BY 1),
      turns AS (SELECT q.*, row_number() OVER (PARTITION BY priority, q.month ORDER BY draw, id) - 1 + coalesce(ms.s, 0) AS turn FROM q LEFT JOIN ms USING (month)),
      places AS (SELECT turns.*, row_number() OVER (PARTITION BY turns.quarter ORDER BY priority DESC, turn, month, draw, id) - 1 AS place, coalesce(qs.s, 0) AS s, coalesce(qs.t, 0) AS t FROM turns LEFT JOIN qs USING (quarter))
      SELECT id, quarter, place, row_number() OVER (ORDER BY s + place, priority DESC, quarter, id) AS rank FROM places {f"WHERE place < greatest(0, {cap} - t)" if cap is not None else ""}"""


@query("stratified_order", _order_sql(False, None))
def stratified_order(spark, d):
    return Q.stratified_order(frontier(spark, d).where("status = 'QUEUED'"))


@query("stratified_order_resumed", _order_sql(True, 200))
def stratified_order_resumed(spark, d):
    rows = frontier(spark, d)
    return Q.stratified_order(rows.where("status = 'QUEUED'"), rows.where("status <> 'QUEUED'"), 200)


@query("claim_queue", _order_sql(True, None) + " QUALIFY rank <= 25")
def claim_queue(spark, d):
    rows = frontier(spark, d).withColumn("next_retry_at", F.lit(None).cast("timestamp_ntz"))
    return Q.claim(rows, F.lit("2024-01-01").cast("timestamp_ntz"), 25)


_CAP = 3
@query(
    "select_captures",
    f"""{_V}, f AS (SELECT id, url_key, substr(timestamp, 1, 4) AS year, timestamp, substr(digest, 1, 1) AS digest, CASE status WHEN 'FETCHED' THEN CASE WHEN id % 9 = 0 THEN 'FETCHED' ELSE 'DISCOVERED' END ELSE 'DISCOVERED' END AS status FROM frontier),
      h AS (SELECT *, bool_or(status = 'FETCHED') OVER (PARTITION BY url_key, year, digest) AS had, row_number() OVER (PARTITION BY url_key, year, digest ORDER BY status = 'DISCOVERED' DESC, timestamp, id) AS first FROM f),
      u AS (SELECT url_key, year, count(DISTINCT digest) AS used FROM f WHERE status = 'FETCHED' GROUP BY ALL),
      d AS (SELECT h.*, {_CAP} - coalesce(used, 0) AS budget, row_number() OVER (PARTITION BY url_key, year ORDER BY timestamp, id) - 1 AS i, count(*) OVER (PARTITION BY url_key, year) AS n FROM h LEFT JOIN u USING (url_key, year) WHERE status = 'DISCOVERED' AND NOT had AND first = 1)
      SELECT id FROM d WHERE budget > 0 AND (n <= budget OR (budget = 1 AND i = n - 1) OR (budget > 1 AND list_contains(list_transform(range(budget), lambda k: CAST(round_even(k * (n - 1) / (budget - 1), 0) AS BIGINT)), i)))""",
)
def select_captures(spark, d):
    rows = frontier(spark, d).withColumn("digest", F.substring("digest", 1, 1))
    rows = rows.withColumn("status", F.when((F.col("status") == "FETCHED") & (F.col("id") % 9 == 0), "FETCHED").otherwise("DISCOVERED"))
    return Q.select_captures(rows, _CAP)


@query("frontier_status_counts", f"{_V}, s(status) AS (VALUES {', '.join(f'({s!r})' for s in Q.STATUSES)}) SELECT s.status, count(f.id) AS n FROM s LEFT JOIN frontier f USING (status) GROUP BY 1")
def frontier_status_counts(spark, d):
    return Q.status_counts(frontier(spark, d))


@query("frontier_status_by_quarter", f"{_V} SELECT {_QUARTER} AS quarter, status, count(*) AS n FROM frontier GROUP BY ALL")
def frontier_status_by_quarter(spark, d):
    return Q.status_by_quarter(frontier(spark, d))


@query("frontier_served_months", f"{_V} SELECT {_MONTH} AS month, count(*) AS served FROM frontier WHERE status IN ('FETCHED', 'FAILED') GROUP BY 1")
def frontier_served_months(spark, d):
    return Q.served(frontier(spark, d))[0]


@query("frontier_taken_quarters", f"{_V} SELECT {_QUARTER} AS quarter, count(*) AS taken FROM frontier WHERE status = 'FETCHED' GROUP BY 1")
def frontier_taken_quarters(spark, d):
    return Q.served(frontier(spark, d))[1]


@query("frontier_coverage", f"{_V} SELECT CAST(substr(timestamp, 1, 4) AS INTEGER) AS year, {_QUARTER} AS quarter, count(*) FILTER (status = 'QUEUED') AS queued, count(*) FILTER (status = 'FETCHED') AS fetched, count(*) FILTER (status = 'FAILED') AS failed, CAST(substr(timestamp, 1, 4) AS INTEGER) IN (1996, 1998) AS complete FROM frontier GROUP BY ALL")
def frontier_coverage(spark, d):
    cursors = spark.createDataFrame([(1996, True), (1998, True)], "year int, complete boolean")
    return Q.coverage(frontier(spark, d), cursors)


@query("explore_sample", f"{_V} SELECT id, row_number() OVER (PARTITION BY substr(timestamp, 1, 4) ORDER BY sha1('7:' || id), id) AS rank FROM frontier QUALIFY rank <= 20")
def explore_sample(spark, d):
    return Q.explore(frontier(spark, d), 20, 7).select("id", "rank")


@query(
    "nearest_captures",
    f"""{_V}, n AS (SELECT r.event_id AS request_id, f.id, f.digest, CAST(abs(epoch(strptime(f.timestamp, '%Y%m%d%H%M%S')) - epoch(date_trunc('second', r.around))) AS BIGINT) AS gap_s, f.timestamp
        FROM (SELECT event_id, 'u' || user_id AS url_key, ts - INTERVAL 26 YEAR AS around FROM events) r JOIN frontier f USING (url_key)),
      o AS (SELECT * FROM n WHERE gap_s <= {183 * 86400} QUALIFY row_number() OVER (PARTITION BY request_id, digest ORDER BY gap_s, timestamp, id) = 1)
      SELECT request_id, id, gap_s, row_number() OVER (PARTITION BY request_id ORDER BY gap_s, timestamp, id) AS rank FROM o QUALIFY rank <= 2""",
)
def nearest_captures(spark, d):
    requests = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url_key"), (F.col("ts") - F.expr("INTERVAL 26 YEARS")).alias("around"))
    return Q.nearest_captures(requests, frontier(spark, d))


_EV = "ev AS (SELECT event_id, 'u' || user_id AS url_key, CASE event_type WHEN 'view' THEN 'LIST' WHEN 'click' THEN 'DETAIL' WHEN 'purchase' THEN 'PAGINATION' ELSE 'CATEGORY' END AS rel FROM events)"


def _links(spark, d):
    kind = F.col("event_type")
    rel = F.when(kind == "view", "LIST").when(kind == "click", "DETAIL").when(kind == "purchase", "PAGINATION").otherwise("CATEGORY")
    return table(spark, d, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url_key"), rel.alias("rel"))


_RANK = "CASE rel WHEN 'DETAIL' THEN 0 WHEN 'LIST' THEN 1 WHEN 'PAGINATION' THEN 2 ELSE 3 END"


@query("link_roles", f"WITH {_EV} SELECT url_key, min_by(rel, {_RANK}) AS rel, count(*) AS seen FROM ev GROUP BY 1")
def link_roles(spark, d):
    return Q.dedupe_links(_links(spark, d))


@query("links_unknown", f"{_V}, {_EV} SELECT url_key, min_by(rel, {_RANK}) AS rel, count(*) AS seen FROM ev WHERE url_key NOT IN (SELECT url_key FROM frontier WHERE id % 7 = 0) GROUP BY 1")
def links_unknown(spark, d):
    return Q.split_links(_links(spark, d), frontier(spark, d).where("id % 7 = 0"))[1]


@query("links_known", f"{_V}, {_EV} SELECT url_key, min_by(rel, {_RANK}) AS rel, count(*) AS seen FROM ev WHERE url_key IN (SELECT url_key FROM frontier WHERE id % 7 = 0) GROUP BY 1")
def links_known(spark, d):
    return Q.split_links(_links(spark, d), frontier(spark, d).where("id % 7 = 0"))[0]


@query(
    "merge_evidence",
    f"""{_V}, {_EV}, n AS (SELECT url_key, list_sort(list_distinct(list(rel))) AS rels FROM ev GROUP BY 1),
      m AS (SELECT f.id, CASE WHEN f.id % 2 = 0 THEN 'SKIPPED' ELSE 'FETCHED' END AS status, list_sort(list_distinct(list_concat(['LIST'], coalesce(rels, [])))) AS linked FROM frontier f LEFT JOIN n USING (url_key))
      SELECT id, CASE WHEN len(linked) > 1 AND status = 'SKIPPED' THEN 'DISCOVERED' ELSE status END AS status, array_to_string(linked, ',') AS linked_as FROM m""",
)
def merge_evidence(spark, d):
    rows = frontier(spark, d).select("id", "url_key", F.when(F.col("id") % 2 == 0, "SKIPPED").otherwise("FETCHED").alias("status"), F.array(F.lit("LIST")).alias("linked_as"))
    return Q.merge_evidence(rows, _links(spark, d)).select("id", "status", F.array_join("linked_as", ",").alias("linked_as"))


@query("retry_backoff", f"{_V} SELECT CASE WHEN id % 3 + 1 >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS status, CASE WHEN id % 3 + 1 < 3 THEN TIMESTAMP '2024-01-01' + to_minutes(CAST(10 * 2 ** (id % 3) AS INTEGER)) END AS next_retry_at, count(*) AS n FROM frontier GROUP BY ALL")
def retry_backoff(spark, d):
    rows = frontier(spark, d).select("id", "status", (F.col("id") % 3).cast("int").alias("attempts"), F.lit(None).cast("timestamp_ntz").alias("next_retry_at"))
    return Q.after_failure(rows, F.lit("2024-01-01").cast("timestamp_ntz")).groupBy("status", "next_retry_at").agg(F.count(F.lit(1)).alias("n"))


@query("release_stale_claims", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 15 MINUTE THEN 'QUEUED' ELSE 'FETCHING' END AS status, count(*) AS n FROM events GROUP BY 1")
def release_stale_claims(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("FETCHING").alias("status"), F.col("ts").alias("claimed_at"))
    return Q.release_stale(rows, F.lit("2024-01-10").cast("timestamp_ntz")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("retry_eligible", "SELECT count(*) AS n FROM events WHERE event_type <> 'error' OR ts <= TIMESTAMP '2024-01-15'")
def retry_eligible(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.col("ts")).alias("next_retry_at"))
    return rows.where(Q.eligible(F.lit("2024-01-15").cast("timestamp_ntz"))).agg(F.count(F.lit(1)).alias("n"))


@query("reopen_frontier", f"{_V} SELECT CASE WHEN (status = 'FAILED' AND priority = 5) OR status = 'FETCHED' OR priority = 1 THEN 'DISCOVERED' ELSE status END AS status, count(*) AS n FROM frontier GROUP BY 1")
def reopen_frontier(spark, d):
    rows = frontier(spark, d).select("id", F.when(F.col("status") == "FAILED", "SKIPPED").otherwise(F.col("status")).alias("status"), F.when(F.col("priority") == 5, "rule:cap").otherwise(F.concat(F.lit("p"), F.col("priority").cast("string"))).alias("route_node"))
    out = Q.reopen(rows, capped_suffix=":cap", routed_by=["p1"], statuses=["FETCHED"])
    return out.groupBy(F.when(F.col("status") == "SKIPPED", "FAILED").otherwise(F.col("status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("resolve_requests", f"{_V}, {_EV}, c AS (SELECT url_key, count(*) AS captures FROM frontier WHERE id % 5 = 0 GROUP BY 1) SELECT CASE WHEN event_id % 6 = 1 THEN CASE WHEN event_id % 4 + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END WHEN captures > 0 THEN 'FOUND' ELSE 'NONE' END AS status, count(*) AS n FROM ev LEFT JOIN c USING (url_key) GROUP BY 1")
def resolve_requests(spark, d):
    ev = _links(spark, d)
    requests = ev.select(F.col("event_id").alias("request_id"), "url_key", (F.col("event_id") % 4).cast("int").alias("attempts"))
    found = requests.join(frontier(spark, d).where("id % 5 = 0").select("url_key"), "url_key").select("request_id")
    failed = requests.where("request_id % 6 = 1").select("request_id")
    return Q.resolve_requests(requests, found, failed).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("spread_sample", f"{_V}, r AS (SELECT id, substr(timestamp, 1, 4) AS year, row_number() OVER (PARTITION BY substr(timestamp, 1, 4) ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY substr(timestamp, 1, 4)) AS n FROM frontier) SELECT id FROM r WHERE n <= 13 OR list_contains(list_transform(range(13), lambda k: (k * n) // 13), i)")
def spread_sample(spark, d):
    rows = frontier(spark, d).select("id", F.substring("timestamp", 1, 4).alias("year"))
    return Q.spread(rows, ["year"], ["id"], 13).select("id")


@query("round_robin", f"{_V}, r AS (SELECT id, priority, row_number() OVER (PARTITION BY priority ORDER BY id) AS turn FROM frontier) SELECT id, turn FROM r ORDER BY turn, priority LIMIT 33")
def round_robin(spark, d):
    return Q.round_robin(frontier(spark, d), "priority", ["id"], 33).select("id", "turn")


@query("link_requests_by_role", f"WITH {_EV} SELECT event_id AS request_id, rel FROM ev ORDER BY {_RANK}, event_id LIMIT 40")
def link_requests_by_role(spark, d):
    return Q.by_role(_links(spark, d).withColumnRenamed("event_id", "request_id"), 40).select("request_id", "rel")


@query("systematic_sample", f"{_V} SELECT id FROM frontier WHERE id % 37 = 0")
def systematic_sample(spark, d):
    return Q.systematic(frontier(spark, d), 37).select("id")


@query("distinct_url_keys", f"{_V} SELECT DISTINCT url_key FROM frontier WHERE status IN ('QUEUED', 'FAILED') AND url_key > 'u5' ORDER BY url_key LIMIT 50")
def distinct_url_keys(spark, d):
    return frontier(spark, d).where(F.col("status").isin("QUEUED", "FAILED") & (F.col("url_key") > "u5")).select("url_key").distinct().orderBy("url_key").limit(50)


@query("cdx_new_captures", f"{_V} SELECT count(*) AS n FROM frontier WHERE sha1(url_key) || timestamp NOT IN (SELECT sha1(url_key) || timestamp FROM frontier WHERE priority = 2)")
def cdx_new_captures(spark, d):
    from ..operators.merge import append_new

    rows = frontier(spark, d).select(F.sha1("url_key").alias("url_key_hash"), "timestamp", "id", "priority")
    known = rows.where("priority = 2")
    keys = ["url_key_hash", "timestamp"]
    return rows.join(append_new(known, rows, keys, [F.col("id")]).select(*keys), keys, "left_semi").agg(F.count(F.lit(1)).alias("n"))
