"""The capture queue: stratified order, capture choice, claims, retries, links, coverage."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..sources.versions import VersionedTable

#: Fixed vocabularies of the queue.
STATUSES = ("DISCOVERED", "UNROUTED", "QUEUED", "FETCHING", "FETCHED", "FAILED", "SKIPPED", "DEFERRED", "EXCLUDED")
SERVED = ("FETCHED", "FETCHING", "FAILED")
TAKEN = ("FETCHED", "FETCHING", "QUEUED")
ROLES = ("DETAIL", "LIST", "PAGINATION", "CATEGORY")
REQUEST_STATUSES = ("PENDING", "FOUND", "NONE", "FAILED")
RETRY_BASE_MINUTES, MOST_ATTEMPTS, CLAIM_MINUTES, LOOKUP_DAYS, LOOKUP_LIMIT = 10, 3, 15, 183, 2
_PAD = "00000101000000"


def padded(timestamp: Column) -> Column:
    """A capture timestamp of 14 digits; a prefix means the start of its period."""
    return F.substring(F.concat(timestamp, F.substring(F.lit(_PAD), F.char_length(timestamp) + 1, F.lit(14))), 1, 14)


def captured_at(timestamp: Column) -> Column:
    return F.try_to_timestamp(padded(timestamp), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def capture_year(timestamp: Column) -> Column:
    return F.substring(timestamp, 1, 4).cast("int")


def capture_month(timestamp: Column) -> Column:
    """``yyyymm``; a bare year counts as January, months are held within 1 to 12."""
    month = F.when(F.char_length(timestamp) >= 6, F.substring(timestamp, 5, 2).cast("int")).otherwise(1)
    return F.concat(F.substring(timestamp, 1, 4), F.lpad(F.least(F.lit(12), F.greatest(F.lit(1), month)).cast("string"), 2, "0"))


def capture_quarter(timestamp: Column) -> Column:
    month = F.substring(capture_month(timestamp), 5, 2).cast("int")
    return F.concat(F.substring(timestamp, 1, 4), F.lit("Q"), (F.floor((month - 1) / 3) + 1).cast("string"))


def scramble(id_: Column) -> Column:
    """Multiplicative hash of an id, modulo 2 ** 64, as a decimal: a fixed pseudo-random draw."""
    return (id_.cast("decimal(18,0)") * F.lit("11400714819323198485").cast("decimal(20,0)")) % F.lit("18446744073709551616").cast("decimal(20,0)")


def stratified_order(rows: DataFrame, past: DataFrame | None = None, per_quarter: int | None = None, first: int | None = None) -> DataFrame:
    """Queued (id, timestamp, priority) in fetch order: id, quarter, place in the quarter, rank from 1.

    A quarter's k-th pick ranks at what the quarter was served plus k; ties go to the higher priority, then the older quarter. In a
    quarter higher priorities go first, then months in turn from the least served, then the draw. ``past`` has the timestamp
    and status of captures already claimed; ``per_quarter`` caps a quarter with what was fetched or claimed. The last step sorts
    the queue as a whole; all ranks before it are by quarter and month. With ``first`` only the first so many of the order are worked out: of each priority and month, then of
    each quarter, tasks keep that many before they shuffle, and the ranks of these heads are merged by heaps; no task sees the queue.
    """
    now = rows.select("id", "priority", capture_month(F.col("timestamp")).alias("month"), capture_quarter(F.col("timestamp")).alias("quarter"))
    if past is not None:
        old = past.select(capture_month(F.col("timestamp")).alias("month"), capture_quarter(F.col("timestamp")).alias("quarter"), F.col("status").isin(*SERVED).cast("long").alias("s"), F.col("status").isin("FETCHED", "FETCHING").cast("long").alias("t"))
        by_month = old.groupBy("month").agg(F.sum("s").alias("month_served"))
        by_quarter = old.groupBy("quarter").agg(F.sum("s").alias("quarter_served"), F.sum("t").alias("quarter_taken"))
        now = now.join(F.broadcast(by_month), "month", "left").join(F.broadcast(by_quarter), "quarter", "left")  # months of the archive
    else:
        now = now.withColumns({"month_served": F.lit(0), "quarter_served": F.lit(0), "quarter_taken": F.lit(0)})
    now = now.fillna(0, ["month_served", "quarter_served", "quarter_taken"]).withColumn("draw", scramble(F.col("id")))
    turn = F.row_number().over(Window.partitionBy("priority", "month").orderBy("draw", "id")) - 1 + F.col("month_served")
    now = now.withColumn("turn", turn)
    if first is not None:  # a quarter's first picks are among the first of each of its priorities and months
        nth = F.row_number().over(Window.partitionBy("priority", "month").orderBy("draw", "id"))
        now = now.withColumn("nth", nth).where(F.col("nth") <= first).drop("nth")
    place = F.row_number().over(Window.partitionBy("quarter").orderBy(F.desc("priority"), "turn", "month", "draw", "id")) - 1
    now = now.withColumn("place", place)
    if first is not None:
        now = now.where(F.col("place") < first)
    if per_quarter is not None:
        now = now.where(F.col("place") < F.greatest(F.lit(0), F.lit(per_quarter) - F.col("quarter_taken")))
    order = [F.col("quarter_served") + F.col("place"), F.desc("priority"), F.col("quarter"), F.col("id")]
    if first is not None:
        heads = now.orderBy(*order).limit(first).select(F.struct((F.col("quarter_served") + F.col("place")).alias("at"), (-F.col("priority")).alias("p"), "quarter", "id", "place").alias("x"))
        ranked = heads.agg(F.array_sort(F.collect_list("x")).alias("xs")).select(F.posexplode("xs").alias("i", "x"))  # ``first`` rows
        return ranked.select("x.id", "x.quarter", F.col("x.place").cast("long").alias("place"), (F.col("i") + 1).cast("long").alias("rank"))
    rank = F.row_number().over(Window.orderBy(*order))
    return now.select("id", "quarter", F.col("place").cast("long").alias("place"), rank.cast("long").alias("rank"))


def select_captures(rows: DataFrame, cap: int) -> DataFrame:
    """Ids to fetch of each URL and year: distinct content, first and last and evenly between, at most ``cap`` with what is taken."""
    year = capture_year(F.col("timestamp"))
    group = ["url_key", "year"]
    rows = rows.select("id", "url_key", year.alias("year"), "timestamp", "digest", "status")
    taken = F.col("status").isin(*TAKEN)
    in_digest = Window.partitionBy(*group, "digest")
    rows = rows.withColumn("had", F.max(taken.cast("int")).over(in_digest)).withColumn("first", F.row_number().over(in_digest.orderBy((F.col("status") == "DISCOVERED").desc(), "timestamp", "id")))
    used = rows.where((F.col("first") == 1) & (F.col("had") == 1)).groupBy(*group).agg(F.count(F.lit(1)).alias("used"))
    fresh = rows.where((F.col("status") == "DISCOVERED") & (F.col("had") == 0) & (F.col("first") == 1))
    whole = Window.partitionBy(*group)
    fresh = fresh.withColumn("i", F.row_number().over(whole.orderBy("timestamp", "id")) - 1).withColumn("n", F.count(F.lit(1)).over(whole))
    fresh = fresh.join(used, group, "left").withColumn("budget", F.lit(cap) - F.coalesce("used", F.lit(0)))
    # Evenly spaced places with banker's rounding: place i is taken if some step of the budget rounds to it.
    step = (F.col("n") - 1) / (F.col("budget") - 1)
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("budget").cast("long") - 1), lambda k: F.bround(k * step).cast("long"))
    chosen = F.when(F.col("n") <= F.col("budget"), True).when(F.col("budget") == 1, F.col("i") == F.col("n") - 1).otherwise(F.array_contains(F.when(F.col("budget") > 1, places), F.col("i").cast("long")))
    return fresh.where("budget > 0").where(chosen).select("id")


def release_stale(rows: DataFrame, now: Column) -> DataFrame:
    """Claims older than the timeout go back to the queue."""
    stale = (F.col("status") == "FETCHING") & (F.col("claimed_at") < now - F.make_dt_interval(mins=F.lit(CLAIM_MINUTES)))
    return rows.withColumns({"status": F.when(stale, "QUEUED").otherwise(F.col("status")), "claimed_at": F.when(~F.coalesce(stale, F.lit(False)), F.col("claimed_at"))})


def eligible(now: Column) -> Column:
    return F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)


def claim(rows: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next rows to fetch, in order; ``claim_from`` also writes their new state."""
    queued = rows.where((F.col("status") == "QUEUED") & eligible(now))
    return stratified_order(queued, rows.where(F.col("status").isin(*SERVED)), first=limit).orderBy("rank")


def claim_from(table: VersionedTable, now: Column, limit: int, worker: str) -> DataFrame:
    """Claim the next ``limit`` rows of a stored queue for a worker; these rows, FETCHING, with their rank.

    The queue (keyed by id) has id, timestamp, priority, status, next_retry_at, claimed_at and claimed_by. Workers may claim at once: of two that picked from the same buckets the later
    one to commit picks anew, so a row is never held twice. Claims older than the timeout are the caller's to release (``release_stale``).
    """
    token = f"{worker}/{uuid.uuid4().hex}"
    ranks = {}

    def picked(queue: DataFrame) -> DataFrame | None:
        rows = claim(queue, now, limit).select("id", "rank").collect()  # ``limit`` rows
        ranks["now"] = rows
        if not rows:
            return None
        ids = queue.sparkSession.createDataFrame([(r.id,) for r in rows], StructType([table.schema["id"]]))
        taken = {"status": F.lit("FETCHING"), "claimed_at": now.cast(table.schema["claimed_at"].dataType), "claimed_by": F.lit(token)}
        return queue.join(F.broadcast(ids), "id", "left_semi").withColumns(taken).select(*table.schema.names)

    table.update(picked, lambda old, new: old.join(new.select("id"), "id", "left_anti").select(*table.schema.names).unionAll(new))
    spark = table.spark
    held = spark.createDataFrame([(r.id, r.rank) for r in ranks["now"]], StructType([table.schema["id"]]).add("rank", LongType()))
    return table.read().where(F.col("claimed_by") == token).join(F.broadcast(held), "id").orderBy("rank")


def after_failure(rows: DataFrame, now: Column) -> DataFrame:
    """Attempts, state and next try after a failure: waits double from ten minutes, the third failure is final."""
    attempts = F.col("attempts") + 1
    final = attempts >= MOST_ATTEMPTS
    wait = F.make_dt_interval(mins=(F.lit(RETRY_BASE_MINUTES) * F.pow(F.lit(2), attempts - 1)).cast("int"))
    return rows.withColumns({"attempts": attempts, "status": F.when(final, "FAILED").otherwise("QUEUED"), "next_retry_at": F.when(~final, now + wait)})


def merge_evidence(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Add link roles to each URL's evidence; rows that were passed over get another look when something is new."""
    new = links.groupBy("url_key").agg(F.array_sort(F.collect_set("rel")).alias("_new"))
    joined = rows.join(new, "url_key", "left")
    old = F.coalesce("linked_as", F.array().cast("array<string>"))
    merged = F.array_sort(F.array_union(old, F.coalesce("_new", F.array().cast("array<string>"))))
    more = F.size(merged) > F.size(old)
    return joined.withColumns({"status": F.when(more & F.col("status").isin("SKIPPED", "DEFERRED", "UNROUTED"), "DISCOVERED").otherwise(F.col("status")), "linked_as": merged}).drop("_new")


def reopen(rows: DataFrame, *, capped_suffix: str | None = None, routed_by: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Back to DISCOVERED: rows skipped for a cap, rows routed by given rules, or rows in given states."""
    hit = F.lit(False)
    if capped_suffix:
        hit = hit | ((F.col("status") == "SKIPPED") & F.col("route_node").endswith(capped_suffix))
    if routed_by:
        hit = hit | F.col("route_node").isin(routed_by)
    if statuses:
        hit = hit | F.col("status").isin(statuses)
    hit = F.coalesce(hit, F.lit(False))
    return rows.withColumns({"status": F.when(hit, "DISCOVERED").otherwise(F.col("status")), "route_node": F.when(~hit, F.col("route_node"))})


def rel_rank(rel: Column) -> Column:
    out = F.lit(len(ROLES))
    for i, name in enumerate(ROLES):
        out = F.when(rel == name, i).otherwise(out)
    return out


def dedupe_links(links: DataFrame) -> DataFrame:
    """One row a URL key with its most specific role."""
    return links.groupBy("url_key").agg(F.min_by("rel", F.struct(rel_rank(F.col("rel")), "rel")).alias("rel"), F.count(F.lit(1)).alias("seen"))


def split_links(links: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links to URLs that the frontier has, and those to ask the archive about."""
    one, keys = dedupe_links(links), known.select("url_key").distinct()
    return one.join(keys, "url_key", "left_semi"), one.join(keys, "url_key", "left_anti")


def nearest_captures(requests: DataFrame, captures: DataFrame, days: int = LOOKUP_DAYS, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """As-of join: of each request's URL the captures nearest in time, of distinct content, within ``days`` days.

    requests: request_id, url_key, around; captures: id, url_key, timestamp, digest. Rows: request_id, id, gap_s, rank. The
    range is part of the equi-join's condition, so only captures inside it leave the join.
    """
    other = captures.select("id", "url_key", "digest", captured_at(F.col("timestamp")).alias("at"))
    gap = F.abs(F.unix_seconds(F.col("at").cast("timestamp")) - F.unix_seconds(F.col("around").cast("timestamp")))
    near = requests.join(other, "url_key").withColumn("gap_s", gap).where(F.col("gap_s") <= days * 86_400)
    once = near.withColumn("_n", F.row_number().over(Window.partitionBy("request_id", "digest").orderBy("gap_s", "at", "id"))).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy("gap_s", "at", "id"))
    return once.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit).select("request_id", "id", "gap_s", "rank")


def resolve_requests(requests: DataFrame, found: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """State after a lookup: FOUND with a capture, else NONE. One that ``failed`` (request_id) tries again, FAILED at the third attempt."""
    hits = found.groupBy("request_id").agg(F.count(F.lit(1)).alias("captures"))
    out = requests.join(hits, "request_id", "left")
    broken = F.lit(False)
    if failed is not None:
        out = out.join(failed.select("request_id").distinct().withColumn("_failed", F.lit(True)), "request_id", "left")
        broken = F.coalesce("_failed", F.lit(False))
    attempts = F.col("attempts") + 1
    state = F.when(broken, F.when(attempts >= MOST_ATTEMPTS, "FAILED").otherwise("PENDING")).when(F.col("captures") > 0, "FOUND").otherwise("NONE")
    return out.withColumns({"captures": F.coalesce("captures", F.lit(0).cast("long")), "status": state, "attempts": attempts}).drop("_failed")


def explore(rows: DataFrame, per_year: int, seed: int) -> DataFrame:
    """A fixed sample of each year, by the sha1 of seed and id."""
    draw = F.sha1(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    rank = F.row_number().over(Window.partitionBy(capture_year(F.col("timestamp"))).orderBy(draw, "id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= per_year)


def spread(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """``k`` rows of each key at even places of its order, all where there are fewer: places floor(i * n / k)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    # Place i is one of them if the next multiple of n / k at or over i is under i + 1.
    step = F.floor((F.col("_i") * k + F.col("_n") - 1) / F.col("_n"))
    hit = (F.col("_n") <= k) | ((step < k) & (F.floor(step * F.col("_n") / k) == F.col("_i")))
    return rows.where(hit).drop("_i", "_n")


def round_robin(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows when keys take turns, each in its own order."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("turn", turn.cast("long")).orderBy("turn", key).limit(k)


def status_counts(rows: DataFrame, statuses=STATUSES) -> DataFrame:
    """Rows of every status, 0 where there are none."""
    names = rows.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return names.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def status_by_quarter(rows: DataFrame) -> DataFrame:
    return rows.groupBy(capture_quarter(F.col("timestamp")).alias("quarter"), "status").agg(F.count(F.lit(1)).alias("n"))


def served(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Served captures a month, and taken ones a quarter (failures excluded)."""
    t = F.col("timestamp")
    return (
        rows.where(F.col("status").isin(*SERVED)).groupBy(capture_month(t).alias("month")).agg(F.count(F.lit(1)).alias("served")),
        rows.where(F.col("status").isin("FETCHED", "FETCHING")).groupBy(capture_quarter(t).alias("quarter")).agg(F.count(F.lit(1)).alias("taken")),
    )


def coverage(rows: DataFrame, cursors: DataFrame | None = None, statuses=("QUEUED", "FETCHED", "FAILED")) -> DataFrame:
    """Year and quarter with a column for each status, and whether the year's enumeration is complete."""
    t = F.col("timestamp")
    wide = rows.groupBy(capture_year(t).alias("year"), capture_quarter(t).alias("quarter")).pivot("status", list(statuses)).agg(F.count(F.lit(1)))
    wide = wide.select("year", "quarter", *(F.coalesce(s, F.lit(0).cast("long")).alias(s.lower()) for s in statuses))
    if cursors is not None:
        wide = wide.join(F.broadcast(cursors.select("year", "complete")), "year", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    return wide


def by_role(requests: DataFrame, limit: int) -> DataFrame:
    return requests.orderBy(rel_rank(F.col("rel")), "request_id").limit(limit)


def systematic(rows: DataFrame, step: int) -> DataFrame:
    return rows.where(F.col("id") % step == 0)
