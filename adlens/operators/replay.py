"""Claimed captures become payloads: of each the stored replay nearest in time, held against the site and the years that are wanted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import host, within_domain
from ..sources.staging import Stage
from ..sources.versions import VersionedTable
from . import frontier as Q

#: Captures that are claimed at once: a scan of the replays serves so many, and their ids pass the driver.
BATCH = 10_000


def payloads(claimed: DataFrame, replays: DataFrame, domain: str, years: tuple[int, int], *, subdomains: bool = False) -> DataFrame:
    """One row a claimed capture: id, claimed_by, outcome, problem, replay_id, served_timestamp, served_url, drift_s (served less requested).

    claimed: id, claimed_by, url_key, timestamp, original_url; replays: replay_id, url_key, timestamp, original_url (what they hold is joined by replay_id later). The archive serves the
    capture nearest to the one that was asked for; of two as near the earlier, then the lesser id. Outcomes: FETCHED; RETRY where nothing is stored; FAILED for good where the URL or what was served is of
    another site, or was served from outside ``years``. A null or malformed timestamp has no nearest replay: RETRY.
    """
    asked = claimed.select("id", "claimed_by", "url_key", F.col("original_url").alias("_url"), Q.captured_at(F.col("timestamp")).alias("_at"))
    held = replays.select("replay_id", "url_key", F.col("timestamp").alias("served_timestamp"), F.col("original_url").alias("served_url"), Q.captured_at(F.col("timestamp")).alias("_served"))
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    near = asked.join(held, "url_key").withColumn("drift_s", seconds("_served") - seconds("_at")).where("drift_s is not null")
    best = near.groupBy("id").agg(F.min_by(F.struct("replay_id", "served_timestamp", "served_url", "drift_s"), F.struct(F.abs("drift_s"), "_served", "replay_id")).alias("x"))
    rows = asked.join(best, "id", "left").select("id", "claimed_by", "_url", "x.*")

    def ours(url: Column) -> Column:
        return F.coalesce(within_domain(url, domain) if subdomains else host(url) == domain.lower().removeprefix("www."), F.lit(False))

    year = Q.capture_year(F.col("served_timestamp"))
    problem = (
        F.when(~ours(F.col("_url")), "another site was asked for").when(F.col("replay_id").isNull(), "nothing is stored")
        .when(~ours(F.col("served_url")), "another site was served").when(~F.coalesce(year.between(*years), F.lit(False)), "served from outside the years")
    )
    outcome = F.when(F.col("problem").isNull(), "FETCHED").when(F.col("problem") == "nothing is stored", "RETRY").otherwise("FAILED")
    return rows.withColumn("problem", problem).select("id", "claimed_by", outcome.alias("outcome"), "problem", "replay_id", "served_timestamp", "served_url", "drift_s")


def settle(queue: VersionedTable, outcomes: DataFrame, now: Column) -> int:
    """Write outcomes (id, claimed_by, outcome) into the queue; a claim that has gone to another worker meanwhile stays that worker's. The queue has ``attempts``, failed ones."""
    names = queue.schema.names

    def settled(rows: DataFrame) -> DataFrame:
        mine = rows.where("status = 'FETCHING'").join(outcomes.select("id", "claimed_by", "outcome"), ["id", "claimed_by"])
        tried = Q.after_failure(mine.withColumn("_had", F.col("attempts")), now)
        out = F.col("outcome")
        new = {
            "status": F.when(out == "RETRY", F.col("status")).otherwise(out), "next_retry_at": F.when(out == "RETRY", F.col("next_retry_at")),
            "attempts": F.when(out == "FETCHED", F.col("_had")).otherwise(F.col("attempts")), "claimed_at": F.lit(None), "claimed_by": F.lit(None),
        }
        cast = {n: c.cast(queue.schema[n].dataType) for n, c in new.items()}
        return tried.withColumns(cast).select(*names)

    return queue.update(settled, lambda old, new: old.join(new.select("id"), "id", "left_anti").select(*names).unionAll(new))


def fetch(queue: VersionedTable, replays: DataFrame, stage: Stage, now: Column, worker: str, *, budget: int, domain: str, years: tuple[int, int], subdomains: bool = False, batch: int = BATCH) -> DataFrame:
    """Claim, replay and settle until ``budget`` (1 or more) attempts are spent or nothing is eligible; the outcomes, stored in ``stage``.

    Failed attempts count too. Outcomes are stored before the queue is: a worker that is lost in between leaves its claims to ``release_stale``, and they are fetched again.
    """
    if budget < 1:
        raise ValueError("a budget of at least one attempt")
    spark, folder, spent = queue.spark, stage.folder("outcomes"), 0
    while spent < budget:
        held = Q.claim_from(queue, now, min(batch, budget - spent), worker)
        found = payloads(F.broadcast(held), replays, domain, years, subdomains=subdomains)  # ``batch`` rows
        part = f"{folder}/claim={spent}"
        found.write.parquet(part)
        stored = spark.read.schema(found.schema).parquet(part)
        claimed = stored.count()
        if not claimed:
            break
        settle(queue, F.broadcast(stored), now)
        spent += claimed
    return spark.read.schema(found.schema).parquet(folder).select(*found.columns)
