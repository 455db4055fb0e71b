"""Observations into current state and history.

The state of a listing is a fold over its sightings in capture order, so it is computed with windows: columns that a capture may
simply not show carry the last value forward, all others are the last sighting's. The order of arrival does not matter.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import BUCKET, VersionedTable

#: Fixed: columns that an archived capture may not show.
CARRIED = ("url", "description", "area_sqm", "bedrooms", "bathrooms", "city", "district", "latitude", "longitude", "listed_at")
UNKNOWN_LOCATION = "unknown"
#: Fixed: fields of the content hash, in order of name.
HASHED = (
    "area_sqm", "attributes", "bathrooms", "bedrooms", "city", "country_code", "currency", "description", "district", "installment_plan", "is_active", "latitude",
    "listed_at", "listing_type", "location_name", "longitude", "price", "price_type", "property_type", "title", "url",
)
KEY = ("source_key", "external_id")


def content_hash(drafts: DataFrame, column: str = "content_hash", ignore: Sequence[str] = ()) -> DataFrame:
    """sha256 of the advert's fields that the table has; provenance (``_`` keys of a map ``attributes``) doesn't count."""
    kinds = dict(drafts.dtypes)
    parts = []
    for name in HASHED:
        if name not in kinds or name in ignore:
            continue
        value = F.col(name)
        if name == "attributes" and kinds[name].startswith("map"):
            value = F.to_json(F.array_sort(F.map_entries(F.map_filter(name, lambda k, v: ~k.startswith("_")))))
        parts.append(value.cast("string").alias(name))
    return drafts.withColumn(column, F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def snapshot(drafts: DataFrame, column: str = "snapshot") -> DataFrame:
    """The advert as this capture showed it, as JSON, never merged with others; and graph_version and template_key of its reading.

    Decimals are texts and times in ISO form; nulls are kept. A map ``attributes`` gives ``raw`` (its entry ``_raw``, a JSON object; {}
    without) and the entry ``_extraction``; without the map both columns are null.
    """
    kinds = dict(drafts.dtypes)
    parts = []
    for name in HASHED:
        if name not in kinds or name == "attributes":
            continue
        value = F.col(name)
        if kinds[name].startswith("decimal"):
            value = value.cast("string")
        elif kinds[name].startswith("timestamp"):
            whole = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
            value = F.when(F.date_trunc("second", name) == F.col(name), whole).otherwise(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        parts.append(value.alias(name))
    entry = lambda k: F.try_element_at("attributes", F.lit(k)) if kinds.get("attributes", "").startswith("map") else F.lit(None).cast("string")
    raw = F.coalesce(F.from_json(entry("_raw"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    said = lambda k: F.get_json_object(entry("_extraction"), f"$.{k}")
    return drafts.withColumns({
        column: F.to_json(F.struct(*parts, raw.alias("raw")), {"ignoreNullFields": "false"}),
        "graph_version": said("graph_version").try_cast("int"), "template_key": F.nullif(F.substring(said("template"), 1, 128), F.lit("")),
    })


def collapse(drafts: DataFrame, now: Column | None = None) -> DataFrame:
    """The latest sighting of each advert in a batch; at the same moment the later position wins. Null times are now."""
    at = F.coalesce("observed_at", now if now is not None else F.current_timestamp().cast("timestamp_ntz"))
    order = Window.partitionBy(*KEY).orderBy(at.desc(), F.desc("position"))
    return drafts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def history(sightings: DataFrame, *within: str) -> DataFrame:
    """One observation per (advert, moment): of several the one processed last (document_id, position). ``within`` are columns by which adverts are dealt out already."""
    # A hash leads, so that sorts compare numbers and few texts.
    order = Window.partitionBy(F.xxhash64(*KEY, "observed_at"), *within, *KEY, "observed_at").orderBy(F.desc("document_id"), F.desc("position"))
    return sightings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def observation_policy(rows: DataFrame) -> DataFrame:
    """Sightings worth an observation: every archived one, of live ones (``historical`` false) the first and each change."""
    order = Window.partitionBy(*KEY).orderBy("observed_at", "document_id", "position")
    before = F.lag("content_hash").over(order)
    first = F.row_number().over(order) == 1
    return rows.withColumn("change", F.when(first, "created").when(before.eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated")).where(
        F.col("historical") | (F.col("change") != "unchanged")
    )


def upsert_counts(rows: DataFrame) -> DataFrame:
    """created, updated and unchanged over all sightings in capture order."""
    order = Window.partitionBy(*KEY).orderBy("observed_at", "document_id", "position")
    before = F.lag("content_hash").over(order)
    first = F.row_number().over(order) == 1
    same = before.eqNullSafe(F.col("content_hash"))
    return rows.select(F.when(first, "created").when(same, "unchanged").otherwise("updated").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def rebuild(rows: DataFrame, carried: Sequence[str] = CARRIED) -> DataFrame:
    """Current state of every advert, from all its sightings.

    Carried columns take the last value that any sighting showed; ``provenance`` names, for those that another capture than
    the last showed, its document. A live sighting (``historical`` false) replaces everything, so nothing is carried
    across it. ``location_name`` ``unknown`` counts as not shown.
    """
    kinds = dict(rows.dtypes)
    carried = [c for c in carried if c in kinds]
    order = Window.partitionBy(*KEY).orderBy("observed_at", "document_id", "position")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Sightings since the last live one form an epoch; values are carried inside it: what an earlier epoch showed last is none. One order, and so one sort, serves all.
    rows = rows.withColumn("_epoch", F.sum((~F.col("historical")).cast("int")).over(upto))

    def shown(value: Column) -> Column:
        return F.last(F.when(value.isNotNull(), F.struct(value.alias("v"), F.col("document_id").alias("d"), F.col("_epoch").alias("e"))), ignorenulls=True).over(upto)

    known = F.when(F.col("location_name") != UNKNOWN_LOCATION, F.col("location_name")) if "location_name" in kinds else None
    out = rows.withColumns(
        {f"_c_{c}": shown(F.col(c)) for c in carried} | ({"_place": shown(known)} if known is not None else {})
        | {"first_observed_at": F.min("observed_at").over(upto), "last_observed_at": F.max("observed_at").over(upto), "sightings": F.count(F.lit(1)).over(upto), "_more": F.lead(F.lit(1)).over(order)}
    ).where("_more is null")
    inside = lambda name: F.when(F.col(name)["e"].eqNullSafe(F.col("_epoch")), F.col(name))
    out = out.withColumns({f"_c_{c}": inside(f"_c_{c}") for c in carried})
    if known is not None:
        out = out.withColumn("location_name", F.coalesce(inside("_place")["v"], F.col("location_name"))).drop("_place")
    pairs = [F.when(F.col(c).isNull() & F.col(f"_c_{c}").isNotNull(), F.concat(F.lit(c + "="), F.col(f"_c_{c}")["d"].cast("string"))) for c in carried]
    out = out.withColumn("provenance", F.array_join(F.array_sort(F.array_compact(F.array(*pairs))), ",") if pairs else F.lit(""))
    out = out.withColumns({c: F.col(f"_c_{c}")["v"] for c in carried})
    return out.drop("_more", "_epoch", *(f"_c_{c}" for c in carried))


def upsert(state: DataFrame, sightings: DataFrame) -> DataFrame:
    """New history after a batch: the stored and the new sightings, later-processed ones winning at the same moment.

    ``state`` is the stored history; ``rebuild`` of the result is the current state, whatever came first.
    """
    return history(state.unionByName(sightings, allowMissingColumns=True))


def merge_batch(table: VersionedTable, sightings: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
    """Fold a batch of sightings into a stored history; the version that holds it.

    Only the buckets that the batch's adverts fall in are read and rewritten. A writer's batch is folded once; writers may be several. Sightings of the batch at the same moment as
    stored ones win if they were processed later, as in ``upsert``.
    """
    fold = lambda old, new: history(old.unionByName(new).repartition(BUCKET), BUCKET)  # noqa: E731  ``upsert``, where the rows will be stored
    return table.update(lambda _: sightings.select(*table.schema.names), fold, writer=writer, batch=batch, dealt=True)


def append_new(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Insert that ignores conflicts: the first new row of each key that the target lacks."""
    fresh = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return fresh.join(target.select(*keys), list(keys), "left_anti")


def mark_stale(listing: DataFrame, cutoff: Column) -> DataFrame:
    return listing.withColumn("is_active", F.col("is_active") & ~F.coalesce(F.col("last_seen_at") < cutoff, F.lit(False)))


def delete_source(listing: DataFrame, observation: DataFrame, source_key: str) -> tuple[DataFrame, DataFrame]:
    """Listings without a source's, and observations without those of the removed listings."""
    gone = listing.where(F.col("source_key") == source_key).select(F.col("id").alias("listing_id"))
    return listing.where(F.col("source_key") != source_key), observation.join(gone, "listing_id", "left_anti")


def mark_document(documents: DataFrame, outcome: DataFrame, most_error: int = 8000) -> DataFrame:
    """Document states after a parse; ``outcome`` has id, status, graph_version and error of those that were parsed."""
    new = outcome.select("id", F.col("status").alias("_s"), F.col("graph_version").alias("_g"), F.substring("error", 1, most_error).alias("_e"))
    done = F.col("_s").isNotNull()
    return documents.join(new, "id", "left").withColumns({
        "status": F.coalesce("_s", "status"), "graph_version": F.coalesce("_g", "graph_version"), "error": F.when(done, F.col("_e")).otherwise(F.col("error")),
        "attempts": F.col("attempts") + done.cast("int"),
    }).drop("_s", "_g", "_e")


def run_status(runs: DataFrame) -> DataFrame:
    """SUCCESS without errors, FAILED where nothing was stored, else PARTIAL."""
    return runs.withColumn("status", F.when(F.col("errors") == 0, "SUCCESS").when(F.col("stored") == 0, "FAILED").otherwise("PARTIAL"))
