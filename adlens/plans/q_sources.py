"""Queries through stored sources: blobs, pages of the archive's index, claims that become payloads."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import host
from ..operators import replay as R
from ..sources import archive_index as A
from ..sources import blob_store as B
from ..sources.staging import fresh
from ..sources.versions import VersionedTable
from ..sources.views import frontier, table
from .q_frontier import _order_sql
from .registry import query


@query("blobs_stored", """WITH p AS (SELECT page_id, html, sha256(html) AS h, DATE '2012-01-01' + CAST(page_id % 366 AS INTEGER) AS day FROM pages WHERE html IS NOT NULL)
  SELECT page_id, 'pages/' || strftime(day, '%Y/%m/%d') || '/' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '.html' AS key, h AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, true AS stored FROM p""")
def blobs_stored(spark, d):
    """All pages put into a blob store, twice, and fetched by their keys."""
    root = fresh(spark, "blobs_stored").folder("blobs")
    day = F.date_add(F.lit("2012-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    content = F.col("html").cast("binary")
    rows = table(spark, d, "pages").where("html is not null").select("page_id", B.content_key(F.lit("pages"), content, day, F.lit("html")).alias("key"), content.alias("content"), F.sha2(content, 256).alias("sha256"))
    for _ in range(2):
        B.store(rows.drop("page_id"), root)
    got = B.exists(B.fetch(rows.select("page_id", "key"), root), root)
    return got.select("page_id", "key", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), "stored")


_PAGE = 50


@query("index_discovered", "SELECT CAST(page_id AS VARCHAR) AS url_key, CAST(2008 + page_id % 3 AS VARCHAR) || '0101000000' AS timestamp, url AS original_url, sha256(url) AS digest FROM pages WHERE url IS NOT NULL")
def index_discovered(spark, d):
    """The index of all pages, stored in pages of 50 by host and year, and read on by ten pages at a time until its end."""
    stage = fresh(spark, "index_discovered")
    root = stage.folder("index")
    row = F.array(F.col("page_id").cast("string"), F.concat(F.col("year").cast("string"), F.lit("0101000000")), F.col("url"), F.sha2("url", 256))
    scope = Window.partitionBy("domain", "year")
    rows = table(spark, d, "pages").where("url is not null").select("page_id", "url", host(F.col("url")).alias("domain"), (2008 + F.col("page_id") % 3).cast("int").alias("year"))
    rows = rows.withColumn("page", F.floor((F.row_number().over(scope.orderBy("page_id")) - 1) / _PAGE).cast("int"))
    listed = rows.groupBy("domain", "year", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # at most 50
    last = F.lead("page").over(scope.orderBy("page")).isNull()
    key = lambda page: F.concat_ws(" ", F.lit("after"), page.cast("string"))
    header = F.array(*map(F.lit, ("urlkey", "timestamp", "original", "digest")))
    none = F.array().cast("array<string>")
    end = F.when(last, F.array().cast("array<array<string>>")).otherwise(F.array(none, F.array(key(F.col("page")))))
    A.store_pages(listed.withColumn("content", F.to_json(F.concat(F.array(header), "rows", end))).withColumn("asked", F.when(F.col("page") > 0, key(F.col("page") - 1))), root)
    schema = StructType([StructField(n, StringType()) for n in ("url_key", "timestamp", "original_url", "digest")])
    found, cursors = VersionedTable(spark, stage.folder("found"), schema, ["url_key", "timestamp"]), VersionedTable(spark, stage.folder("cursors"), A.CURSORS, ["source_key", "scope"])
    while A.discover(root, "pages", found, cursors, max_pages=10):
        pass
    return found.read()


_YEARS, _BUDGET = (1995, 1999), 25


@query("payloads_fetched", f"""WITH c AS (SELECT id FROM ({_order_sql(True, None)}) WHERE rank <= {_BUDGET}), f AS (SELECT o_orderkey AS id, o_custkey AS u, o_orderstatus = 'F' AS stored, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS at FROM orders),
  n AS (SELECT q.id, r.id AS replay_id, r.at AS served, epoch(r.at) - epoch(q.at) AS drift FROM c JOIN f q USING (id) JOIN f r ON r.u = q.u AND r.stored QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY abs(epoch(r.at) - epoch(q.at)), r.at, r.id) = 1)
  SELECT c.id, coalesce(replay_id, -1) AS replay_id, coalesce(CAST(drift AS BIGINT), 0) AS drift_s, CASE WHEN c.id % 7 = 0 THEN 'FAILED' WHEN replay_id IS NULL THEN 'RETRY' WHEN year(served) BETWEEN {_YEARS[0]} AND {_YEARS[1]} THEN 'FETCHED' ELSE 'FAILED' END AS outcome,
    CASE WHEN c.id % 7 = 0 THEN 'FAILED' WHEN replay_id IS NULL THEN 'QUEUED' WHEN year(served) BETWEEN {_YEARS[0]} AND {_YEARS[1]} THEN 'FETCHED' ELSE 'FAILED' END AS status FROM c LEFT JOIN n USING (id)""")
def payloads_fetched(spark, d):
    """The first claims of a stored queue as payloads, with the state that the queue keeps of them."""
    stage = fresh(spark, "payloads_fetched")
    none, key = F.lit(None), F.col("url_key")
    url = F.concat(F.when(F.col("id") % 7 == 0, "http://elsewhere.example/").otherwise("http://www.shop.example/"), key)
    rows = frontier(spark, d)
    queued = rows.select("id", "url_key", url.alias("original_url"), "timestamp", "priority", "status", F.lit(0).alias("attempts"), none.cast("timestamp_ntz").alias("next_retry_at"), none.cast("timestamp_ntz").alias("claimed_at"), none.cast("string").alias("claimed_by"))
    replays = rows.where("status = 'FETCHED'").select(F.col("id").alias("replay_id"), "url_key", "timestamp", F.concat(F.lit("http://shop.example/"), key).alias("original_url"))
    queue = VersionedTable(spark, stage.folder("queue"), queued.schema, ["id"])
    queue.update(lambda _: queued, lambda old, new: new)
    found = R.fetch(queue, replays, stage, F.lit("2024-01-01").cast("timestamp_ntz"), "w", budget=_BUDGET, domain="shop.example", years=_YEARS)
    return found.join(queue.read().select("id", "status"), "id").select("id", F.coalesce("replay_id", F.lit(-1).cast("long")).alias("replay_id"), F.coalesce("drift_s", F.lit(0).cast("long")).alias("drift_s"), "outcome", "status")
