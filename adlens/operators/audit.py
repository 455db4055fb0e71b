"""Audits of an extraction: diffs, completeness, collisions, yield, gold scores, census."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Full outer: key, outcome (added, lost, common), the fields that changed and those that were filled, both joined by commas."""
    a = before.select(*keys, *(F.col(f).alias(f"_a_{f}") for f in fields), F.lit(True).alias("_a"))
    b = after.select(*keys, *(F.col(f).alias(f"_b_{f}") for f in fields), F.lit(True).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    changed = F.array_compact(F.array(*(F.when(both & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")) & F.col(f"_a_{f}").isNotNull(), F.lit(f)) for f in fields)))
    filled = F.array_compact(F.array(*(F.when(both & F.col(f"_a_{f}").isNull() & F.col(f"_b_{f}").isNotNull(), F.lit(f)) for f in fields)))
    outcome = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "lost").otherwise("common")
    return a.join(b, list(keys), "full_outer").select(*keys, outcome.alias("outcome"), F.array_join(changed, ",").alias("changed"), F.array_join(filled, ",").alias("filled"))


def diff_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("changed") != "").alias("changed"), F.count_if(F.col("filled") != "").alias("filled"))


def completeness(drafts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """How many rows show each field; an empty string is not shown. One pass, then one row a field."""
    one = drafts.agg(*(F.count_if(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull()).alias(f) for f in fields), F.count(F.lit(1)).alias("_all"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("shown"), F.col("_all").alias("rows")) for f in fields))).alias("x")).select("x.*")


def collisions(pages: DataFrame, most: int = 5) -> DataFrame:
    """Ids that more than one detail page claims, with the first few of their URLs."""
    urls = F.array_sort(F.collect_set("url"))
    return pages.groupBy("external_id").agg(urls.alias("u")).where("size(u) > 1").select("external_id", F.size("u").alias("pages"), F.array_join(F.slice("u", 1, most), ",").alias("urls"))


def latest_sighting(rows: DataFrame) -> DataFrame:
    """One row an advert: the last sighting, at the same moment a detail page before a list row, then the greater document."""
    order = [F.desc("observed_at"), (F.col("page_kind") == "DETAIL").desc(), F.desc("document_id")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("external_id").orderBy(*order))).where("_n = 1").drop("_n")


def yield_by_quarter(rows: DataFrame, quarter: Column) -> DataFrame:
    """Documents, documents with adverts, adverts first seen in the quarter, and these per 100 documents to one place.

    rows: document_id, external_id (null for a document without adverts), observed_at.
    """
    rows = rows.withColumn("quarter", quarter)
    docs = rows.groupBy("quarter", "document_id").agg(F.count("external_id").alias("k")).groupBy("quarter").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("k") > 0).alias("with_adverts"))
    first = rows.where("external_id is not null").groupBy("external_id").agg(F.min_by("quarter", F.struct("observed_at", "document_id")).alias("quarter"))
    new = first.groupBy("quarter").agg(F.count(F.lit(1)).alias("first_seen"))
    out = docs.join(new, "quarter", "left").withColumn("first_seen", F.coalesce("first_seen", F.lit(0).cast("long")))
    return out.withColumn("per_100", F.round(100 * F.col("first_seen") / F.col("documents"), 1))


def gold_score(gold: DataFrame, drafts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """items, found, exact, a count of misses for each field, rate. Gold items are verified ones; the rate of none is 1."""
    got = drafts.select("external_id", *(F.col(f).alias(f"_d_{f}") for f in fields), F.lit(True).alias("_hit"))
    joined = gold.join(got, "external_id", "left")
    hit = F.col("_hit").isNotNull()
    wrong = {f: hit & ~F.col(f).eqNullSafe(F.col(f"_d_{f}")) for f in fields}
    exact = hit
    for w in wrong.values():
        exact = exact & ~w
    out = joined.agg(F.count(F.lit(1)).alias("items"), F.count_if(hit).alias("found"), F.count_if(exact).alias("exact"), *(F.count_if(w).alias(f"miss_{f}") for f, w in wrong.items()))
    return out.withColumn("rate", F.when(F.col("items") == 0, 1.0).otherwise(F.col("exact") / F.col("items")))


def without_observation(documents: DataFrame, observation: DataFrame) -> DataFrame:
    return documents.join(observation.select(F.col("document_id").alias("id")), "id", "left_anti")


def shared_documents(observation: DataFrame, group: Column) -> DataFrame:
    """Documents whose observations fall into more than one ``group``."""
    return observation.groupBy("document_id").agg(F.countDistinct(group).alias("groups")).where("groups > 1")


def ledger(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls, valid ones, tokens in and out; missing counts are 0."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("valid").alias("valid"), F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out")
    )


def gaps(misses: DataFrame, most: int = 5) -> DataFrame:
    """Clusters of unhandled inputs from the largest: occurrences and the first few samples."""
    grouped = misses.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("occurrences"), F.min("sample").alias("sample"))
    return grouped.orderBy(F.desc("occurrences"), "fingerprint").limit(most)


def record_gaps(known: DataFrame, found: DataFrame, samples: int = 8, regrowth: int = 4) -> DataFrame:
    """Stored gaps after new findings: occurrences replaced, RESOLVED reopened, FAILED reopened once ``regrowth`` times as large.

    known: fingerprint, status, occurrences, failed_occurrences, samples; found: fingerprint, occurrences, samples. New samples first.
    """
    new = found.select("fingerprint", F.col("occurrences").alias("_o"), F.col("samples").alias("_s"))
    j = known.join(new, "fingerprint", "full_outer")
    grown = F.col("_o") >= regrowth * F.greatest(F.lit(1), F.coalesce("failed_occurrences", F.lit(0)))
    status = F.when(F.col("status").isNull(), "OPEN").when(F.col("_o").isNull(), F.col("status")).when((F.col("status") == "RESOLVED") | ((F.col("status") == "FAILED") & grown), "OPEN").otherwise(F.col("status"))
    none = F.array().cast("array<string>")
    merged = F.slice(F.array_distinct(F.concat(F.coalesce("_s", none), F.coalesce("samples", none))), 1, samples)
    return j.select("fingerprint", status.alias("status"), F.coalesce("_o", "occurrences").alias("occurrences"), merged.alias("samples"))


def needs_review(identity_problems: Column, kind: Column, advert_links: Column, valid: Column, total: Column) -> Column:
    """Identity problems, a page of no kind that links to three adverts or more, or under 60 % valid of at least two items."""
    return (identity_problems > 0) | ((kind == "OTHER") & (advert_links >= 3)) | ((total >= 2) & (F.try_divide(valid, total) < 0.6))


def parse_rollup(reports: DataFrame) -> DataFrame:
    """Totals of parse reports by page kind."""
    return reports.groupBy("page_kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("items").alias("items"), F.sum("valid").alias("valid"), F.sum("dropped").alias("dropped"), F.count_if(F.col("identity_problems") > 0).alias("identity_problems"))


def latest_per_key(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def census(rows: DataFrame, by: Sequence[str], **sums: str) -> DataFrame:
    """Rows by any columns, with sums (``name=column``)."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(n) for n, c in sums.items()))


def keys_only(a: DataFrame, b: DataFrame, key: str, how: str) -> DataFrame:
    """Key sets: ``added`` (in b alone), ``lost`` (in a alone), ``common``."""
    a, b = a.select(key).distinct(), b.select(key).distinct()
    return {"added": b.join(a, key, "left_anti"), "lost": a.join(b, key, "left_anti"), "common": a.join(b, key, "left_semi")}[how]


def legacy_rows(sale: DataFrame, rent: DataFrame, key: str, full: Column) -> DataFrame:
    """Import: rent rows whose id is a sale's go; a sparse row goes where a full one has its id."""
    rent = rent.join(sale.select(key), key, "left_anti")
    every = sale.withColumn("listing_type", F.lit("SALE")).unionByName(rent.withColumn("listing_type", F.lit("RENT"))).withColumn("_full", full)
    complete = every.where("_full").select(key).distinct()
    return every.where("_full").unionByName(every.where(~F.col("_full")).join(complete, key, "left_anti")).drop("_full")


def import_report(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return rows.join(kept.select(key).distinct().withColumn("_k", F.lit(1)), key, "left").groupBy(F.when(F.col("_k").isNotNull(), "kept").otherwise("skipped").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def last_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rewrite of a delete with a self-join: of rows that repeat ``keys`` the newest stays."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def fill_from(rows: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Rewrite of an update with a join: a null ``column`` takes the source's value."""
    return rows.join(source.select(key, F.col(column).alias("_v")), key, "left").withColumn(column, F.coalesce(column, "_v")).drop("_v")
