"""Audit queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources.views import LISTING_SQL, OBSERVATION_SQL, listing, observation, table
from .registry import query

_A = "a AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS area FROM part WHERE p_partkey % 10 <> 3)"
_B = "b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN upper(p_name) ELSE p_name END AS title, p_size AS area FROM part WHERE p_partkey % 10 <> 7)"
_DIFF = f"""WITH {_A}, {_B}, d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'lost' ELSE 'common' END AS outcome,
  concat_ws(',', CASE WHEN a.id = b.id AND a.title <> b.title THEN 'title' END, CASE WHEN a.id = b.id AND a.area IS DISTINCT FROM b.area AND a.area IS NOT NULL THEN 'area' END) AS changed,
  concat_ws(',', CASE WHEN a.id = b.id AND a.title IS NULL THEN 'title' END, CASE WHEN a.id = b.id AND a.area IS NULL AND b.area IS NOT NULL THEN 'area' END) AS filled FROM a FULL JOIN b ON a.id = b.id)"""


def _two(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    a = part.where(k % 10 != 3).select(k.alias("id"), F.col("p_name").alias("title"), F.when(k % 4 != 0, F.col("p_size")).alias("area"))
    b = part.where(k % 10 != 7).select(k.alias("id"), F.when(k % 6 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("title"), F.col("p_size").alias("area"))
    return a, b


@query("extraction_diff", _DIFF + " SELECT * FROM d")
def extraction_diff(spark, d):
    return A.diff(*_two(spark, d), ["id"], ["title", "area"])


@query("extraction_diff_counts", _DIFF + " SELECT outcome, count(*) AS n, count(*) FILTER (changed <> '') AS changed, count(*) FILTER (filled <> '') AS filled FROM d GROUP BY 1")
def extraction_diff_counts(spark, d):
    return A.diff_counts(A.diff(*_two(spark, d), ["id"], ["title", "area"]))


for _how, _sql in (("added", "SELECT id FROM b EXCEPT SELECT id FROM a"), ("lost", "SELECT id FROM a EXCEPT SELECT id FROM b"), ("common", "SELECT id FROM a INTERSECT SELECT id FROM b")):
    query(f"keys_{_how}", f"WITH {_A}, {_B} {_sql}")(lambda spark, d, how=_how: A.keys_only(*_two(spark, d), "id", how))

_FIELDS = ("title", "description", "area_sqm", "bedrooms", "district", "latitude", "listed_at")


@query("field_completeness", f"WITH {LISTING_SQL}, c AS (SELECT {', '.join(f'count({f}) AS {f}' for f in _FIELDS)}, count(*) AS all_rows FROM listing) " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS shown, all_rows AS rows FROM c" for f in _FIELDS))
def field_completeness(spark, d):
    return A.completeness(listing(spark, d), _FIELDS)


@query("identity_collisions", "WITH p AS (SELECT 'id' || (page_id % 100) AS external_id, url FROM pages) SELECT external_id, CAST(count(DISTINCT url) AS INTEGER) AS pages, array_to_string(list_slice(list_sort(list_distinct(list(url))), 1, 5), ',') AS urls FROM p GROUP BY 1 HAVING count(DISTINCT url) > 1")
def identity_collisions(spark, d):
    return A.collisions(table(spark, d, "pages").select(F.concat(F.lit("id"), (F.col("page_id") % 100).cast("string")).alias("external_id"), "url"))


_SEEN = "s AS (SELECT CAST(l_partkey AS VARCHAR) AS external_id, l_shipdate AS observed_at, CASE WHEN l_linenumber % 2 = 0 THEN 'DETAIL' ELSE 'LIST' END AS page_kind, l_orderkey * 10 + l_linenumber AS document_id, l_extendedprice AS price, l_suppkey FROM lineitem)"


def _seen(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("external_id"), F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_linenumber") % 2 == 0, "DETAIL").otherwise("LIST").alias("page_kind"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"), F.col("l_extendedprice").alias("price"), "l_suppkey",
    )


@query("latest_sighting", f"WITH {_SEEN} SELECT external_id, max(observed_at) AS observed_at, arg_max(page_kind, (observed_at, page_kind = 'DETAIL', document_id)) AS page_kind, arg_max(document_id, (observed_at, page_kind = 'DETAIL', document_id)) AS document_id FROM s GROUP BY 1")
def latest_sighting(spark, d):
    return A.latest_sighting(_seen(spark, d)).select("external_id", "observed_at", "page_kind", "document_id")


@query(
    "yield_by_quarter",
    f"""WITH {_SEEN}, r AS (SELECT document_id, CASE WHEN l_suppkey % 4 <> 0 THEN external_id END AS external_id, observed_at, year(observed_at) || 'Q' || quarter(observed_at) AS quarter FROM s),
      d AS (SELECT quarter, count(DISTINCT document_id) AS documents, count(DISTINCT document_id) FILTER (external_id IS NOT NULL) AS with_adverts FROM r GROUP BY 1),
      f AS (SELECT quarter, count(*) AS first_seen FROM (SELECT external_id, arg_min(quarter, (observed_at, document_id)) AS quarter FROM r WHERE external_id IS NOT NULL GROUP BY 1) GROUP BY 1)
      SELECT quarter, documents, with_adverts, coalesce(first_seen, 0) AS first_seen, round(100 * coalesce(first_seen, 0) / documents, 1) AS per_100 FROM d LEFT JOIN f USING (quarter)""",
)
def yield_by_quarter(spark, d):
    rows = _seen(spark, d).withColumn("external_id", F.when(F.col("l_suppkey") % 4 != 0, F.col("external_id")))
    at = F.col("observed_at")
    return A.yield_by_quarter(rows, F.concat(F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string")))


@query("gold_score", """WITH g AS (SELECT doc_id, quality, toxic FROM labels), p AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS q, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS t FROM documents WHERE doc_id % 5 <> 0)
  SELECT count(*) AS items, count(p.doc_id) AS found, count(*) FILTER (quality = q AND toxic = t) AS exact, count(*) FILTER (quality <> q) AS miss_quality, count(*) FILTER (toxic <> t) AS miss_toxic, count(*) FILTER (quality = q AND toxic = t) / count(*) AS rate FROM g LEFT JOIN p USING (doc_id)""")
def gold_score(spark, d):
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("external_id"), "quality", "toxic")
    drafts = table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("external_id"), (F.col("n_chars") > 1000).cast("int").alias("quality"), (F.col("lang") == "de").cast("int").alias("toxic"))
    return A.gold_score(gold, drafts, ["quality", "toxic"])


@query("documents_unobserved", "SELECT o_orderkey AS id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def documents_unobserved(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return A.without_observation(docs, observation(spark, d).where("price_type = 'TOTAL'"))


@query("documents_mixed", f"WITH {OBSERVATION_SQL}, {LISTING_SQL} SELECT document_id, count(DISTINCT regexp_extract(source_key, '#(\\d)', 1)) AS groups FROM observation JOIN listing ON listing.id = listing_id GROUP BY 1 HAVING groups > 1")
def documents_mixed(spark, d):
    rows = observation(spark, d).join(listing(spark, d).select(F.col("id").alias("listing_id"), "source_key"), "listing_id")
    return A.shared_documents(rows, F.regexp_extract("source_key", r"#(\d)", 1))


@query("documents_mixed_all", f"WITH {OBSERVATION_SQL}, {LISTING_SQL} SELECT document_id, count(DISTINCT regexp_extract(source_key, '#(\\d)', 1)) AS groups FROM observation JOIN listing ON listing.id = listing_id GROUP BY 1 HAVING groups > 1")
def documents_mixed_all(spark, d):
    rows = observation(spark, d).join(listing(spark, d).select(F.col("id").alias("listing_id"), "source_key"), "listing_id")
    return A.shared_documents(rows, F.regexp_extract("source_key", r"#(\d)", 1))


@query("llm_ledger", "SELECT event_type AS task, count(*) AS calls, count(*) FILTER (value > 10) AS valid, CAST(sum(coalesce(CASE WHEN user_id % 3 <> 0 THEN user_id END, 0)) AS BIGINT) AS tokens_in, CAST(sum(event_id) AS BIGINT) AS tokens_out FROM events GROUP BY 1")
def llm_ledger(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("task"), (F.col("value") > 10).alias("valid"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("tokens_in"), F.col("event_id").alias("tokens_out"))
    return A.ledger(calls, ["task"])


@query("gap_top", "SELECT p_brand AS fingerprint, count(*) AS occurrences, min(p_name) AS sample FROM part GROUP BY 1 ORDER BY occurrences DESC, fingerprint LIMIT 5")
def gap_top(spark, d):
    return A.gaps(table(spark, d, "part").select(F.col("p_brand").alias("fingerprint"), F.col("p_name").alias("sample")))


@query("gap_record", """WITH f AS (SELECT p_brand AS fingerprint, count(*) AS o FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
  k AS (SELECT DISTINCT p_brand AS fingerprint, CASE WHEN length(p_brand) = 7 THEN 'RESOLVED' WHEN p_brand < 'Brand#2' THEN 'FAILED' ELSE 'ASKED' END AS status FROM part)
  SELECT fingerprint, CASE WHEN f.o IS NULL THEN status WHEN status = 'RESOLVED' OR (status = 'FAILED' AND f.o >= 4 * 7) THEN 'OPEN' ELSE status END AS status, coalesce(f.o, 1) AS occurrences FROM k LEFT JOIN f USING (fingerprint)""")
def gap_record(spark, d):
    part = table(spark, d, "part")
    brand = F.col("p_brand")
    known = part.select(brand.alias("fingerprint")).distinct().select("fingerprint", F.when(F.length("fingerprint") == 7, "RESOLVED").when(F.col("fingerprint") < "Brand#2", "FAILED").otherwise("ASKED").alias("status"), F.lit(1).cast("long").alias("occurrences"), F.lit(7).alias("failed_occurrences"), F.array(F.lit("old")).alias("samples"))
    found = part.where("p_partkey % 3 = 0").groupBy(brand.alias("fingerprint")).agg(F.count(F.lit(1)).alias("occurrences"), F.slice(F.array_sort(F.collect_set("p_name")), 1, 8).alias("samples"))
    return A.record_gaps(known, found).select("fingerprint", "status", "occurrences")


@query("review_flags", "SELECT o_orderpriority = '1-URGENT' OR (o_orderstatus = 'O' AND o_custkey % 7 >= 3) OR (o_custkey % 5 >= 2 AND (o_orderkey % 4) / (o_custkey % 5) < 0.6) AS review, count(*) AS n FROM orders GROUP BY 1")
def review_flags(spark, d):
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "OTHER").otherwise("LIST")
    flag = A.needs_review((F.col("o_orderpriority") == "1-URGENT").cast("int"), kind, F.col("o_custkey") % 7, F.col("o_orderkey") % 4, F.col("o_custkey") % 5)
    return o.groupBy(F.coalesce(flag, F.lit(False)).alias("review")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_rollup", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'LIST' ELSE 'DETAIL' END AS page_kind, count(*) AS documents, CAST(sum(n) AS BIGINT) AS items, CAST(sum(v) AS BIGINT) AS valid, CAST(sum(n - v) AS BIGINT) AS dropped, count(*) FILTER (o_orderkey % 50 = 0) AS identity_problems FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def parse_rollup(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("l_returnflag") != "R").alias("valid"))
    reports = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.when(F.col("o_orderstatus") == "F", "LIST").otherwise("DETAIL").alias("page_kind"), "items", "valid", (F.col("items") - F.col("valid")).alias("dropped"), (F.col("o_orderkey") % 50 == 0).cast("int").alias("identity_problems")
    )
    return A.parse_rollup(reports)


@query("latest_run_per_source", "SELECT event_type AS source_key, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1")
def latest_run_per_source(spark, d):
    runs = table(spark, d, "events").select(F.col("event_type").alias("source_key"), F.col("event_id").alias("id"), "ts")
    return A.latest_per_key(runs, "source_key", [F.desc("ts"), F.desc("id")]).select("source_key", "id")


@query("census_observations", f"WITH {OBSERVATION_SQL} SELECT strftime(observed_at, '%Y-%m') AS month, currency, price_type, count(*) AS n FROM observation GROUP BY ALL")
def census_observations(spark, d):
    rows = observation(spark, d).withColumn("month", F.date_format("observed_at", "yyyy-MM"))
    return A.census(rows, ["month", "currency", "price_type"])


@query("census_documents", "SELECT source, lang, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def census_documents(spark, d):
    return A.census(table(spark, d, "documents").withColumn("size", F.octet_length("text").cast("long")), ["source", "lang"], bytes="size")


@query("census_hashes", "SELECT source, count(DISTINCT sha256(text)) AS hashes FROM documents GROUP BY 1")
def census_hashes(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct(F.sha2("text", 256)).alias("hashes"))


@query("census_props", "SELECT event_type, CAST(props->>'$.k' AS BIGINT) % 10 AS digit, count(*) AS n FROM events GROUP BY ALL")
def census_props(spark, d):
    rows = table(spark, d, "events").withColumn("digit", F.get_json_object("props", "$.k").cast("long") % 10)
    return A.census(rows, ["event_type", "digit"])


@query("graph_rule_counts", "SELECT p_brand AS graph, count(*) AS nodes, count(*) FILTER (p_size > 25) AS templates FROM part GROUP BY 1")
def graph_rule_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("graph")).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("p_size") > 25).alias("templates"))


@query("removed_rules", "SELECT DISTINCT p_type || p_size AS node FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT p_type || p_size FROM part WHERE p_partkey % 3 = 0")
def removed_rules(spark, d):
    part = table(spark, d, "part").withColumn("node", F.concat("p_type", F.col("p_size").cast("string")))
    return A.keys_only(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 3 = 0"), "node", "lost")


_LEG = "sale AS (SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus AS st FROM orders WHERE o_orderkey % 3 <> 0), rent AS (SELECT o_orderkey AS id, o_totalprice / 100 AS price, o_orderstatus AS st FROM orders WHERE o_orderkey % 2 = 0)"


def _legacy(spark, d):
    o = table(spark, d, "orders")
    one = lambda w, p: o.where(w).select(F.col("o_orderkey").alias("id"), p.alias("price"), F.col("o_orderstatus").alias("st"))
    return one("o_orderkey % 3 <> 0", F.col("o_totalprice")), one("o_orderkey % 2 = 0", F.col("o_totalprice") / 100)


@query("legacy_import", f"WITH {_LEG} SELECT id, 'SALE' AS listing_type FROM sale UNION ALL SELECT id, 'RENT' FROM rent WHERE id NOT IN (SELECT id FROM sale)")
def legacy_import(spark, d):
    return A.legacy_rows(*_legacy(spark, d), "id", F.col("st") != "P").select("id", "listing_type")


@query("legacy_report", f"WITH {_LEG}, k AS (SELECT id FROM sale) SELECT CASE WHEN id IN (SELECT id FROM k) THEN 'skipped' ELSE 'kept' END AS outcome, count(*) AS n FROM rent GROUP BY 1")
def legacy_report(spark, d):
    sale, rent = _legacy(spark, d)
    kept = A.legacy_rows(sale, rent, "id", F.lit(True)).where("listing_type = 'RENT'")
    return A.import_report(rent, kept, "id")


@query("dedupe_observations", "SELECT l_partkey, l_shipdate, max(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def dedupe_observations(spark, d):
    return A.last_of(table(spark, d, "lineitem"), ["l_partkey", "l_shipdate"], [F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_partkey", "l_shipdate", "l_orderkey")


@query("fill_from_join", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'own' END, c_mktsegment) AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def fill_from_join(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "own").alias("segment"))
    return A.fill_from(rows, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), "k", "segment").select("o_orderkey", "segment")
