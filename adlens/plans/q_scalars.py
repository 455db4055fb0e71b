"""Scalar queries over pages, documents, conversations and events."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import scalars as X
from ..operators import frontier as Q
from ..sources.views import table
from .registry import query

_HOST = r"regexp_replace(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.'), '^www\d*\.', '')"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"


@query("url_parts", f"SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", X.host(u).alias("host"), X.path(u).alias("path"), X.query_string(u).alias("query"))


@query(
    "surt_key",
    f"""WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS q FROM pages)
      SELECT page_id, lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || coalesce(nullif(rtrim(path, '/'), ''), '/') ||
        CASE WHEN q <> '' THEN '?' || array_to_string(list_transform(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '')), lambda x: regexp_replace(x, '=$', '')), '&') ELSE '' END) AS surt FROM p""",
)
def surt_key(spark, d):
    return table(spark, d, "pages").select("page_id", X.surt_key(F.col("url")).alias("surt"))


@query("site_roots", f"SELECT trim({_PATH}, '/') = '' AND {_QUERY} = '' AS root, count(*) AS n FROM pages GROUP BY 1")
def site_roots(spark, d):
    return table(spark, d, "pages").groupBy(X.is_site_root(F.col("url")).alias("root")).agg(F.count(F.lit(1)).alias("n"))


@query("domain_pages", f"SELECT page_id FROM pages WHERE {_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net')")
def domain_pages(spark, d):
    return table(spark, d, "pages").where(X.within_domain(F.col("url"), "example.net")).select("page_id")


@query("canonical_ids", r"SELECT page_id, nullif(regexp_extract(url, '/(\d+)(?:\.html|/)?(?:[?#]|$)', 1), '') AS id FROM pages WHERE NOT regexp_matches(url, '/fr/')")
def canonical_ids(spark, d):
    pages = table(spark, d, "pages").where(~F.col("url").contains("/fr/"))
    return pages.select("page_id", X.canonical_id(F.col("url"), [r"/(\d+)(?:\.html|/)?(?:[?#]|$)"], ["/fr/"]).alias("id"))


@query("redact_documents", r"SELECT doc_id, CASE WHEN contains(text, '@') THEN regexp_replace(text, '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}', '[redacted]', 'g') ELSE text END AS text FROM documents")
def redact_documents(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.when(text.contains("@"), F.regexp_replace(text, X.EMAIL, "[redacted]")).otherwise(text).alias("text"))


@query("redact_all")
def redact_all(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("text"))


_DIGITS = f"translate(text, '{X.DIGITS_FROM}', '{X.DIGITS_TO}')"
_END = r"(?:[^\p{L}\p{N}_]|$)"


@query(
    "first_numbers",
    rf"""WITH n AS (SELECT doc_id, regexp_extract({_DIGITS}, '(?i)(?:^|[^\d.])(\d{{1,3}}(?:[,\s\x0B]\d{{3}})+|\d+)(\.\d+)?(?:[\s\x0B]*(?:(مليون|million)|(mn){_END}|(ألف|الف|آلاف|الاف|thousand))|(?:(m)|(k)){_END})?', ['whole', 'part', 'million', 'mn', 'thousand', 'm', 'k']) AS x
    FROM documents)
  SELECT doc_id, CAST(CAST(TRY_CAST(TRY_CAST(nullif(regexp_replace(x.whole, '[,\s\x0B]', '', 'g'), '') || x.part AS DECIMAL(30,6)) * CAST(CASE WHEN x.million || x.mn || x.m <> '' THEN 1000000 WHEN x.thousand || x.k <> '' THEN 1000 ELSE 1 END AS DECIMAL(7,0)) AS DECIMAL(30,6)) AS VARCHAR) AS DOUBLE) AS v FROM n""",
)
def first_numbers(spark, d):
    """The first number of every document; null where there is none."""
    return table(spark, d, "documents").select("doc_id", X.first_number(F.col("text")).cast("double").alias("v"))


@query("prices_read")
def prices_read(spark, d):
    """Synthetic price texts of every part: amount, currency, wording."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.format_string("EGP %d per month", k)).when(k % 4 == 1, F.concat(F.lit("ج.م"), F.format_number(k * 1000, 0))).when(k % 4 == 2, F.format_string("$%d,500", k % 900 + 1)).otherwise(F.format_string("%d million down payment", k))
    return table(spark, d, "part").select(k.alias("id"), X.first_number(text).cast("double").alias("amount"), X.currency(text).alias("currency"), X.price_wording(text).alias("wording"))


@query("areas_read", "SELECT p_partkey AS id, CASE WHEN v BETWEEN 5 AND 1000000 THEN CAST(v AS DOUBLE) END AS area FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 40 AS DECIMAL(24,2)) ELSE round(CAST(p_size * 100 AS DECIMAL(20,0)) * 0.092903, 2) END AS v FROM part)")
def areas_read(spark, d):
    text = F.when(F.col("p_partkey") % 2 == 0, F.format_string("%d m2", F.col("p_size") * 40)).otherwise(F.format_string("%d sq ft", F.col("p_size") * 100))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.area_sqm(text).cast("double").alias("area"))


@query("sparse_numbers", r"SELECT event_id, TRY_CAST(nullif(regexp_replace(props, '[^0-9]', '', 'g'), '') AS BIGINT) AS n, CASE WHEN CAST(props->>'$.k' AS BIGINT) BETWEEN 0 AND 50 THEN CAST(props->>'$.k' AS INTEGER) END AS small FROM events")
def sparse_numbers(spark, d):
    return table(spark, d, "events").select("event_id", X.sparse_number(F.col("props")).alias("n"), P.small_count(F.get_json_object("props", "$.k")).alias("small"))


@query("capture_periods", "SELECT o_orderkey AS id, CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS year, strftime(o_orderdate, '%Y%m') AS month, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, date_trunc('month', o_orderdate)::TIMESTAMP AS at FROM orders")
def capture_periods(spark, d):
    t = F.date_format("o_orderdate", "yyyyMM")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), Q.capture_year(t).alias("year"), Q.capture_month(t).alias("month"), Q.capture_quarter(t).alias("quarter"), Q.captured_at(t).alias("at"))


@query("scramble_draw", "SELECT o_orderkey AS id, CAST((CAST(o_orderkey AS HUGEINT) * 11400714819323198485) % 18446744073709551616 AS VARCHAR) AS draw FROM orders")
def scramble_draw(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), Q.scramble(F.col("o_orderkey")).cast("string").alias("draw"))


@query("fingerprint_distance")
def fingerprint_distance(spark, d):
    a, b = (F.substring(F.md5(F.col(c).cast("string")), 1, 16) for c in ("o_orderkey", "o_custkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.hamming(a, b).alias("bits"))


@query("token_hashes", "SELECT c_custkey AS id, sha256(lower(trim(c_name))) AS token FROM customer")
def token_hashes(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.token_hash(X.email(F.col("c_name"))).alias("token"))


@query("points_in_box", "SELECT p_partkey AS id, CASE WHEN p_partkey % 90 BETWEEN 22 AND 32 AND p_partkey % 180 BETWEEN 25 AND 37 THEN CAST(p_partkey % 90 AS DOUBLE) END AS lat FROM part")
def points_in_box(spark, d):
    k = F.col("p_partkey")
    text = F.concat((k % 180).cast("string"), F.lit(", "), (k % 90).cast("string"))
    return table(spark, d, "part").select(k.alias("id"), X.point_in_box(text, (22, 32), (25, 37))["lat"].alias("lat"))


@query("drop_reasons", "SELECT event_type || ' conflict' AS reason, count(*) AS n FROM events GROUP BY 1")
def drop_reasons(spark, d):
    problem = F.concat(F.lit("item "), F.col("event_id").cast("string"), F.lit(": "), F.col("event_type"), F.lit(" conflict: url says "), F.col("user_id").cast("string"))
    return table(spark, d, "events").groupBy(X.drop_reason(problem).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("clean_titles", r"SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages".replace('\\"', '"'))
def clean_titles(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


@query("installment_flag", r"SELECT conv_id, turn, regexp_matches(text, '(?i)\bdp\b|instal?ment') AS flag FROM conversations")
def installment_flag(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").rlike(r"(?iu)\bdp\b|instal?ment").alias("flag"))


@query("dominant_script", "SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[؀-ۿ]')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'ar' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' END AS script FROM conversations")
def dominant_script(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.script_of(F.col("text")).alias("script"))
