"""Files that hold adverts and captures: listing JSON, search responses, archive indexes, raw bytes, gold labels; and sinks."""
from __future__ import annotations

import gzip
import re
from collections.abc import Mapping
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed code tables of the listing JSON.
PURPOSE = {"rent": "RENT", "for-rent": "RENT", "sale": "SALE", "for-sale": "SALE"}
CATEGORY = {"apartment": "APARTMENT", "flat": "APARTMENT", "villa": "VILLA", "townhouse": "TOWNHOUSE", "house": "HOUSE", "studio": "STUDIO", "land": "LAND", "office": "OFFICE", "shop": "RETAIL", "retail": "RETAIL", "warehouse": "WAREHOUSE"}
PERIOD = {"total": "TOTAL", "monthly": "PER_MONTH", "weekly": "PER_WEEK", "nightly": "PER_NIGHT", "yearly": "PER_YEAR", "per-sqm": "PER_SQM", "installment": "INSTALLMENT"}
#: Fixed code tables of the search responses.
RENT_PERIOD = {"1": "PER_NIGHT", "2": "PER_WEEK", "3": "PER_MONTH", "4": "PER_YEAR"}
APARTMENT_CODE = {"4": "STUDIO"}
VILLA_CODE = {"3": "TOWNHOUSE"}
COMMERCIAL_CODE = {"5": "RETAIL", "6": "OFFICE", "8": "WAREHOUSE"}

ITEM = (
    "struct<id:string,title:string,description:string,purpose:string,category:string,price:struct<value:string,currency:string,period:string,installment_plan:string>,area:string,beds:string,baths:string,"
    "location:struct<name:string,city:string,district:string,country:string,lat:string,lng:string>,url:string,created_at:string,active:boolean>"
)


def coded(value: Column, table: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.lower(value) == k, v).otherwise(out)
    return out


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: file, content."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def listing_drafts(files: DataFrame, max_items: int | None = None) -> DataFrame:
    """Drafts of listing JSON (``results`` array); items without id or title, or that aren't objects, are left out.

    files: file, content. ``position`` is the item's place in its file; ``max_items`` caps each file's items.
    """
    items = F.from_json(F.get_json_object("content", "$.results"), "array<string>")
    raw = files.select("file", F.posexplode(items).alias("position", "raw"))
    if max_items is not None:
        raw = raw.where(F.col("position") < max_items)
    x = F.from_json("raw", ITEM)
    rows = raw.withColumn("x", x).where("x.id is not null and x.title is not null")
    number = lambda c: F.col(c).try_cast("double")
    return rows.select(
        "file", "position", F.col("x.id").alias("external_id"), F.col("x.title").alias("title"), F.col("x.description").alias("description"), F.col("x.url").alias("url"),
        coded(F.col("x.purpose"), PURPOSE, "SALE").alias("listing_type"), coded(F.col("x.category"), CATEGORY, "OTHER").alias("property_type"),
        number("x.price.value").alias("price"), F.coalesce("x.price.currency", F.lit("USD")).alias("currency"), coded(F.col("x.price.period"), PERIOD, "TOTAL").alias("price_type"),
        F.col("x.price.installment_plan").alias("installment_plan"), number("x.area").alias("area_sqm"), F.col("x.beds").try_cast("int").alias("bedrooms"), F.col("x.baths").try_cast("int").alias("bathrooms"),
        F.coalesce("x.location.name", F.lit("Unknown")).alias("location_name"), F.col("x.location.country").alias("country_code"), F.col("x.location.city").alias("city"), F.col("x.location.district").alias("district"),
        number("x.location.lat").alias("latitude"), number("x.location.lng").alias("longitude"), F.try_to_timestamp("x.created_at").alias("listed_at"), F.coalesce("x.active", F.lit(True)).alias("is_active"),
    )


def search_drafts(responses: DataFrame, url_template: str = "https://example.com/ad/{slug}-ID{id}.html") -> DataFrame:
    """Drafts of search responses (content, category): hits with an id; localised names first, code maps by category."""
    hits = F.from_json(F.get_json_object("content", "$.responses[0].hits.hits"), "array<string>")
    raw = responses.select("category", F.explode(hits).alias("hit"))
    at = lambda path: F.get_json_object("hit", f"$._source{path}")
    text = lambda *paths: F.coalesce(*(F.nullif(F.trim(at(p)), F.lit("")) for p in paths))
    level = lambda i: text(f"['location.lvl{i}'].name_l1", f"['location.lvl{i}'].name")
    extra = lambda k: at(f".extraFields.{k}")
    rent = F.col("category").endswith("-for-rent") | F.coalesce(at(".purpose") == "for-rent", F.lit(False))
    code = F.coalesce(extra("type"), F.lit(""))
    kind = (
        F.when(F.col("category").contains("apartments-duplex"), coded(code, APARTMENT_CODE, "APARTMENT")).when(F.col("category").contains("villas"), coded(code, VILLA_CODE, "VILLA"))
        .when(F.col("category").contains("commercial"), coded(code, COMMERCIAL_CODE, "OTHER")).when(F.col("category").contains("buildings-lands"), "LAND").otherwise("OTHER")
    )
    parts = F.coalesce(extra("payment_option"), F.lit("1")) == "2"
    price_type = F.when(rent, coded(F.coalesce(extra("rental_period"), F.lit("3")), RENT_PERIOD, "PER_MONTH")).when(parts, "INSTALLMENT").otherwise("TOTAL")
    slug = F.coalesce(at(".slug_l1"), at(".slug"))
    before, after = url_template.split("{slug}")
    middle, end = after.split("{id}")
    return raw.where(F.coalesce(at(".externalID"), F.lit("")) != "").select(
        at(".externalID").alias("external_id"), F.coalesce(text(".title_l1", ".title"), F.lit("")).alias("title"), F.coalesce(text(".description_l1", ".description"), F.lit("")).alias("description"),
        F.when(rent, "RENT").otherwise("SALE").alias("listing_type"), kind.alias("property_type"), extra("price").try_cast("double").alias("price"), F.lit("EGP").alias("currency"), price_type.alias("price_type"),
        F.when(~rent & parts, extra("down_payment")).alias("down_payment"), extra("ft").try_cast("double").alias("area_sqm"),
        F.regexp_replace(extra("rooms"), "[^0-9]", "").try_cast("int").alias("bedrooms"), F.regexp_replace(extra("bathrooms"), "[^0-9]", "").try_cast("int").alias("bathrooms"),
        F.coalesce(level(4), level(3), level(2), level(1), F.lit("Egypt")).alias("location_name"), level(1).alias("city"), F.coalesce(level(2), level(3)).alias("district"),
        at(".geography.lat").try_cast("double").alias("latitude"), at(".geography.lng").try_cast("double").alias("longitude"), (at(".state") == "active").alias("is_active"),
        F.timestamp_seconds(at(".createdAt").try_cast("double").cast("long")).alias("listed_at"),
        F.when(slug.isNotNull(), F.concat(F.lit(before), slug, F.lit(middle), at(".externalID"), F.lit(end))).alias("url"),
    )


def captures(files: DataFrame) -> DataFrame:
    """Captures of archive index pages (a header row, rows, and at the end maybe an empty row and a resume key).

    files: file, content. Rows: file, position, url_key, timestamp, original_url, digest. Short rows are left out.
    """
    rows = files.select("file", F.from_json("content", "array<array<string>>").alias("rows")).where("size(rows) > 0")
    header = F.element_at("rows", 1)
    flat = rows.select("file", header.alias("header"), F.posexplode("rows").alias("position", "row"))
    flat = flat.where((F.col("position") > 0) & (F.size("row") >= F.size("header")))
    get = lambda name: F.try_element_at("row", F.array_position("header", F.lit(name)).cast("int"))
    has = F.array_contains("header", "digest")
    return flat.select("file", "position", get("urlkey").alias("url_key"), get("timestamp").alias("timestamp"), get("original").alias("original_url"), F.when(has, F.try_element_at("row", F.greatest(F.lit(1), F.array_position("header", F.lit("digest")).cast("int")))).otherwise(get("timestamp")).alias("digest"))


def resume_keys(files: DataFrame) -> DataFrame:
    """file and the resume key that its page ends with, null without one."""
    rows = files.select("file", F.from_json("content", "array<array<string>>").alias("rows"))
    n = F.size("rows")
    ends = (n >= 3) & (F.size(F.try_element_at("rows", F.lit(-2))) == 0) & (F.size(F.try_element_at("rows", F.lit(-1))) == 1)
    return rows.select("file", F.when(ends, F.try_element_at("rows", F.lit(-1))[0]).alias("resume_key"))


def good_captures(index: DataFrame, status: str = "200", mime: str = "text/html") -> DataFrame:
    return index.where((F.col("statuscode") == status) & (F.col("mimetype") == mime))


_KEY = re.compile(r"^[a-z0-9_]+/\d{4}/\d{2}/\d{2}/[0-9a-f-]{36}\.[a-z0-9]+$")


def blob_key(source_key: str, name: str, when: datetime, extension: str) -> str:
    """Day-partitioned path of raw bytes; anything that isn't canonical is an error."""
    key = f"{source_key}/{when:%Y/%m/%d}/{name}.{extension}"
    if not _KEY.match(key):
        raise ValueError(f"not a blob key: {key}")
    return key


def key_day(path: Column) -> Column:
    return F.to_date(F.regexp_extract(path, r"/(\d{4}/\d{2}/\d{2})/", 1), "yyyy/MM/dd")


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Raw files with their day and sha256; a path with a day's folder reads that day alone. Scans pass empty files over; ``blob_store.fetch`` reads these too."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content", key_day(F.col("path")).alias("day"), F.sha2("content", 256).alias("sha256"))


def html_text(rows: DataFrame, content: str = "content", content_type: str | None = None) -> DataFrame:
    """``html``: bytes decoded by their declared charset or the page's own, gunzipped where they are gzip."""
    from ..functions.urls import decode_bytes

    @F.pandas_udf("string")
    def text(data: pd.Series, kinds: pd.Series) -> pd.Series:
        plain = (gzip.decompress(b) if b is not None and b[:2] == b"\x1f\x8b" else b for b in data)
        return pd.Series([None if b is None else decode_bytes(bytes(b), k) for b, k in zip(plain, kinds, strict=True)])

    return rows.withColumn("html", text(F.col(content), F.col(content_type) if content_type else F.lit(None).cast("string")))


def gold_items(files: DataFrame) -> DataFrame:
    """Items of verified gold files: file, external_id, title, amount, currency, listing_type."""
    schema = "struct<verified:boolean,items:array<struct<external_id:string,title:string,amount:string,currency:string,listing_type:string>>>"
    x = files.select("file", F.from_json("content", schema).alias("x")).where("x.verified")
    return x.select("file", F.explode("x.items").alias("i")).select("file", "i.external_id", "i.title", F.col("i.amount").try_cast("double").alias("amount"), "i.currency", "i.listing_type")


def write_partitioned(observation: DataFrame, path: str) -> None:
    """Observations by month; a rewrite replaces the months it has."""
    out = observation.withColumn("month", F.date_format("observed_at", "yyyy-MM"))
    out.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def report(rows: DataFrame) -> DataFrame:
    """Rows of an audit as JSON lines."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
