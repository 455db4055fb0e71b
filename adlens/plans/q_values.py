"""Values read out of texts, file payloads and plausibility: texts are made of known numbers, so the SQL states what must come out."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..operators import stats as S
from ..operators.rules import shapes
from ..sources import files as S_
from ..sources.views import table
from .registry import query


@query("prices_parsed", """WITH t AS (SELECT p_partkey AS id, p_partkey % 8 AS form,
    CASE p_partkey % 8 WHEN 0 THEN p_partkey + 100.0 WHEN 1 THEN p_partkey * 1000.0 WHEN 2 THEN (p_partkey % 900 + 1) * 1000 + 500.0 WHEN 3 THEN p_partkey * 1000000.0 WHEN 5 THEN p_partkey + 100.0 WHEN 6 THEN p_partkey % 10 * 1.0 WHEN 7 THEN p_partkey + 200.0 END::DOUBLE AS said,
    CASE p_partkey % 8 WHEN 0 THEN 'EGP' WHEN 1 THEN 'EGP' WHEN 2 THEN 'USD' WHEN 5 THEN 'GBP' WHEN 6 THEN 'USD' END AS currency,
    CASE p_partkey % 8 WHEN 0 THEN 'PER_MONTH' WHEN 3 THEN 'INSTALLMENT' WHEN 6 THEN 'PER_NIGHT' ELSE 'TOTAL' END AS kind FROM part WHERE p_partkey > 0),
  b AS (SELECT *, CASE WHEN said BETWEEN CASE form WHEN 6 THEN 5 ELSE 100 END AND 999999999999 THEN said END AS amount FROM t)
  SELECT id, amount, currency, CASE WHEN form = 4 THEN 'ON_REQUEST' WHEN amount IS NULL THEN 'UNKNOWN' ELSE kind END AS price_type FROM b""")
def prices_parsed(spark, d):
    k = F.col("p_partkey")
    text = (
        F.when(k % 8 == 0, F.format_string("EGP %d per month", k + 100)).when(k % 8 == 1, F.concat(F.lit("ج.م"), F.format_number(k * 1000, 0))).when(k % 8 == 2, F.format_string("$%d,500", k % 900 + 1))
        .when(k % 8 == 3, F.format_string("%d million down payment", k)).when(k % 8 == 4, "Call for price").when(k % 8 == 5, F.format_string("a %d sqm flat at %d GBP", k % 300 + 20, k + 100))
        .when(k % 8 == 6, F.format_string("%d USD per night", k % 10)).otherwise(F.format_string("%d or %d", k + 100, k + 200))
    )
    read = table(spark, d, "part").where("p_partkey > 0").select(k.alias("id"), P.price(text).alias("p"))
    return read.select("id", F.col("p.amount").cast("double").alias("amount"), "p.currency", "p.price_type")


@query("periods_parsed", "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'PER_MONTH' WHEN 1 THEN 'PER_WEEK' WHEN 2 THEN 'PER_NIGHT' WHEN 3 THEN 'PER_YEAR' END AS period FROM orders")
def periods_parsed(spark, d):
    texts = F.array(*map(F.lit, ("paid monthly", "per week", "daily rent", "سنوي", "monthly or yearly")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), P.rental_period(F.get(texts, (F.col("o_orderkey") % 5).cast("int"))).alias("period"))


@query("counts_parsed", "SELECT o_orderkey AS id, CAST(CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 60 <= 50 THEN o_orderkey % 60 END WHEN 1 THEN 3 WHEN 2 THEN 2 END AS INTEGER) AS n FROM orders")
def counts_parsed(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.format_string("%d beds", k % 60)).when(k % 4 == 1, "Three rooms").when(k % 4 == 2, "غرفتين نوم").otherwise("none said")
    return table(spark, d, "orders").select(k.alias("id"), P.small_count(text).alias("n"))


@query("dates_parsed", "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 5 THEN date_trunc('day', o_orderdate) + INTERVAL 2 DAY WHEN 7 THEN NULL ELSE date_trunc('day', o_orderdate) END AS at FROM orders")
def dates_parsed(spark, d):
    k, day = F.col("o_orderkey"), F.date_trunc("day", "o_orderdate")
    text = (
        F.when(k % 8 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 8 == 1, F.date_format(day, "d MMMM yyyy")).when(k % 8 == 2, F.date_format(day, "MMM d, yyyy")).when(k % 8 == 3, F.date_format(day, "d/M/yyyy"))
        .when(k % 8 == 4, "posted 3 days ago").when(k % 8 == 5, "yesterday").when(k % 8 == 6, F.date_format(day, "d MMM")).otherwise("no date")
    )
    return table(spark, d, "orders").select(k.alias("id"), P.listed_at(text, day.cast("timestamp_ntz") + F.expr("INTERVAL 3 DAYS")).cast("timestamp_ntz").alias("at"))


@query("dates_epoch", "SELECT event_id AS id, date_trunc('second', ts) AS at FROM events")
def dates_epoch(spark, d):
    """Odd ids in milliseconds, even ones in seconds."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 2 == 0, seconds).otherwise(seconds * 1000).cast("string")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), P.listed_at(text, F.col("ts")).alias("at"))


def _nations(spark, d):
    """Names of nations (25 rows at any size) with a second name each."""
    return {r[0]: [f"land {r[1]} of the sea"] for r in table(spark, d, "nation").select("n_name", "n_nationkey").collect()}


@query("places_named", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 4 THEN n_name END AS place FROM customer JOIN nation ON n_nationkey = c_nationkey")
def places_named(spark, d):
    names = _nations(spark, d)
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey")
    text = F.when(k % 5 == 4, "somewhere else").when(k % 5 == 3, F.format_string("Lánd %d, of the Sea", F.col("n_nationkey"))).otherwise(F.concat(F.lit("Flat near "), F.lower("n_name"), F.lit("-centre")))
    return rows.select(k.alias("id"), P.named_place(text, names).alias("place"))


@query("country_names", "SELECT n_nationkey AS id, n_nationkey IN (1, 7) AS is_country, CASE WHEN n_nationkey = 3 THEN 'NATION_3' END AS abroad FROM nation")
def country_names(spark, d):
    name = F.concat(F.initcap("n_name"), F.lit(""))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), P.is_named(name, ["Nation 1", "nation-7"]).alias("is_country"), P.named_place(F.concat(F.lit("a house in "), name), {"NATION_3": []}).alias("abroad"))


@query("labels_resolved", """SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN r_name WHEN 1 THEN r_name WHEN 3 THEN r_name END AS city, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN 'Elsewhere' END AS district,
  CASE c_custkey % 4 WHEN 2 THEN 'Elsewhere' END AS unresolved FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def labels_resolved(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    pairs = dict(tuple(r) for r in nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect())  # 25 rows at any size
    rows = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    label = F.when(k % 4 == 0, F.concat("n_name", F.lit(" , "), "r_name")).when(k % 4 == 1, F.concat(F.lit("Street 9, "), "n_name")).when(k % 4 == 2, F.lit("Block, Elsewhere")).otherwise(F.col("r_name"))
    return rows.select(k.alias("id"), P.city_district(label, sorted(set(pairs.values())), pairs).alias("x")).select("id", "x.*")


@query("url_shape_counts", r"""WITH h AS (SELECT url, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\d*\.', '') AS host FROM pages WHERE regexp_matches(url, '://[^/]*/[a-z]{2}/\d+(\.html)?([?#]|$)')),
  s AS (SELECT CASE WHEN len(string_split(host, '.')) > 3 AND string_split(host, '.')[1] NOT IN ('m', 'mobile') THEN '*.' || array_to_string(string_split(host, '.')[2:], '.') ELSE host END || '/' || regexp_extract(url, '://[^/]*/([a-z]{2})/', 1)
    || '/' || CASE WHEN regexp_matches(url, '\.html([?#]|$)') THEN '*-X.html' ELSE '*' END || '|d1' || CASE WHEN contains(url, 'page=') THEN '|q:page,ref' WHEN contains(url, 'utm_source=') THEN '|q:utm_source' ELSE '' END AS shape FROM h)
  SELECT shape, count(*) AS n FROM s GROUP BY 1""")
def url_shape_counts(spark, d):
    rows = table(spark, d, "pages").where(F.col("url").rlike(r"://[^/]*/[a-z]{2}/\d+(\.html)?([?#]|$)"))
    return shapes(rows).groupBy("shape").agg(F.count(F.lit(1)).alias("n"))


@query("index_captures", "SELECT 'f' || (page_id % 50) AS file, CAST(page_id AS VARCHAR) AS url_key, url AS original_url, sha256(url) AS digest FROM pages WHERE url IS NOT NULL")
def index_captures(spark, d):
    """Index pages of the archive, written from ``pages`` and read again."""
    row = F.array(F.col("page_id").cast("string"), F.lit("20130101000000"), F.col("url"), F.sha2("url", 256))
    files = table(spark, d, "pages").where("url is not null").groupBy(F.concat(F.lit("f"), (F.col("page_id") % 50).cast("string")).alias("file")).agg(F.collect_list(row).alias("rows"))
    header = F.array(*map(F.lit, ("urlkey", "timestamp", "original", "digest")))
    content = files.select("file", F.to_json(F.concat(F.array(header), "rows", F.array(F.array().cast("array<string>"), F.array(F.lit("resume"))))).alias("content"))
    return S_.captures(content).select("file", "url_key", "original_url", "digest")


@query("gold_files", "SELECT 'f' || (l_orderkey % 97) AS file, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS external_id, 'Flat ' || l_partkey AS title, l_extendedprice AS amount, CASE WHEN l_returnflag = 'N' THEN 'SALE' ELSE 'RENT' END AS listing_type FROM lineitem WHERE l_orderkey % 97 % 3 <> 0")
def gold_files(spark, d):
    """Gold files, written from ``lineitem`` and read again; those that aren't verified are passed over."""
    item = F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("external_id"), F.format_string("Flat %d", F.col("l_partkey")).alias("title"), F.col("l_extendedprice").cast("string").alias("amount"), F.lit("EGP").alias("currency"), F.when(F.col("l_returnflag") == "N", "SALE").otherwise("RENT").alias("listing_type"))
    files = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 97).alias("f")).agg(F.collect_list(item).alias("items"))
    content = files.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), F.to_json(F.struct((F.col("f") % 3 != 0).alias("verified"), "items")).alias("content"))
    return S_.gold_items(content).select("file", "external_id", "title", "amount", "listing_type")


@query("plausible_rows", """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'SALE' ELSE 'RENT' END AS listing_type, CASE WHEN l_returnflag = 'N' THEN l_extendedprice * 10 ELSE l_extendedprice / 10 END AS price, l_quantity * 2 AS area_sqm, l_suppkey % 3 AS k FROM lineitem)
  SELECT l_orderkey, l_linenumber, price, CASE WHEN area_sqm BETWEEN 30 AND 2000 THEN area_sqm END AS area_sqm FROM r WHERE k <> 1 AND ((listing_type = 'SALE' AND price BETWEEN 100000 AND 2000000000) OR (listing_type = 'RENT' AND price BETWEEN 500 AND 1000000))""")
def plausible_rows(spark, d):
    sale = F.col("l_returnflag") == "N"
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(sale, "SALE").otherwise("RENT").alias("listing_type"), F.when(sale, F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice") / 10).alias("price"),
        (F.col("l_quantity") * 2).alias("area_sqm"), F.get(F.array(F.lit("APARTMENT"), F.lit("LAND"), F.lit("VILLA")), (F.col("l_suppkey") % 3).cast("int")).alias("property_type"),
    )
    return S.plausible(rows).select("l_orderkey", "l_linenumber", "price", "area_sqm")


@query("movers", """WITH b AS (SELECT p_type AS kind, year(l_shipdate) AS y, l_extendedprice / l_quantity AS v FROM lineitem JOIN part ON p_partkey = l_partkey),
  g AS (SELECT kind, count(*) FILTER (y = 1996) AS n0, count(*) FILTER (y = 1999) AS n1, median(v) FILTER (y = 1996) AS m0, median(v) FILTER (y = 1999) AS m1 FROM b GROUP BY 1)
  SELECT kind, round(m1 / m0 - 1, 6) AS change FROM g WHERE n0 >= 40 AND n1 >= 40""")
def movers(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_type").alias("kind"), F.year("l_shipdate").alias("y"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    return S.movers(rows, "v", "kind", F.col("y"), 1996, 1999).select("kind", F.round("change", 6).alias("change"))


@query("redacted_keys", """SELECT event_id AS id, '{"note":"mail [redacted] ' || event_type || '","more":[{"k":' || user_id || '}],"names":{"a":"call [redacted]"}}' AS x FROM events""")
def redacted_keys(spark, d):
    """Sensitive keys go, at any depth, and texts are redacted."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.struct(
        F.lit("0101").alias("seller_phone"), F.concat(F.lit("mail a@b.com "), F.col("event_type")).alias("note"), F.array(F.struct(F.col("user_id").alias("k"), F.lit("x").alias("Api-Key"))).alias("more"),
        F.create_map(F.lit("a"), F.lit("call 01012345678"), F.lit("e_mail"), F.lit("b")).alias("names"),
    ).alias("x"))
    return rows.select("id", F.to_json(P.redact_nested(F.col("x"), rows.schema["x"].dataType)).alias("x"))
