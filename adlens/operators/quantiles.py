"""Exact quantiles and ranks of groups of any size: values are counted, and only bands of like values are ever sorted in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands for each factor of e, so that a band's values lie within 1.6 % of each other.
BANDS = 64


def band(value: Column) -> Column:
    """Number of a value's band, never null. It never falls as values grow, so bands can be ranked before the values in them."""
    size = F.floor(F.least(F.log(F.abs(value)), F.lit(1000.0)) * BANDS).cast("int") + 50_000
    return F.coalesce(F.when(value > 0, size).when(value < 0, -size), F.lit(0))


def before_bands(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _b, _c, _o, _n: values of each band, values of the key in lower bands, values of the key. ``counts`` has keys, _b, _t."""
    totals = counts.groupBy(*keys, "_b").agg(F.sum("_t").alias("_c"))
    key = Window.partitionBy(*keys)
    return totals.withColumn("_o", F.sum("_c").over(key.orderBy("_b")) - F.col("_c")).withColumn("_n", F.sum("_c").over(key))


def _same(keys: Sequence[str]) -> Column:
    """Null-safe equality of the sides ``c`` and ``o``."""
    out = F.col("c._b") == F.col("o._b")
    for k in keys:
        out = out & F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}"))
    return out


def value_counts(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """keys, _v, _t: each distinct value of a key as a double, and its rows. Null values don't count."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_t"))


def exact_quantiles(rows: DataFrame, value: str, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """keys, n and ``q``, an array of the exact quantiles ``qs`` of each group, by linear interpolation.

    Null values don't count; a group without others is left out, and a null key is a group of its own. Equal values are combined before
    the shuffle; of each group only the bands in which a quantile falls are sorted.
    """
    return quantiles_of(value_counts(rows, value, keys), keys, qs)


def quantiles_of(counts: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``exact_quantiles`` of what ``value_counts`` gives."""
    counts = counts.withColumn("_b", band(F.col("_v")))
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    wanted = F.array_distinct(F.array(*(f(at(q)) for q in qs for f in (F.floor, F.ceil))))
    held = lambda places, size: F.filter(places, lambda r: (r >= F.col("_o")) & (r < F.col("_o") + F.col(size)))
    bands = before_bands(counts, keys).withColumn("_r", held(wanted, "_c")).where(F.size("_r") > 0)
    near = counts.alias("c").join(bands.alias("o"), _same(keys)).select(*(F.col(f"c.{k}").alias(k) for k in keys), "_v", "_t", "c._b", "_o", "_n", "_r")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    near = near.withColumn("_o", F.col("_o") + F.sum("_t").over(inside) - F.col("_t")).withColumn("_r", held(F.col("_r"), "_t")).where(F.size("_r") > 0)
    # At most two places a quantile are left of each group.
    entry = F.transform("_r", lambda r: F.struct(r.alias("r"), F.col("_v").alias("v")))
    found = near.groupBy(*keys).agg(F.max("_n").alias("_n"), F.map_from_entries(F.flatten(F.collect_list(entry))).alias("_m"))

    def quantile(q: float) -> Column:
        low, high = F.floor(at(q)), F.ceil(at(q))
        a, b = F.element_at("_m", low), F.element_at("_m", high)
        return F.when(low == high, a).otherwise((high - at(q)) * a + (at(q) - low) * b)

    return found.select(*keys, F.col("_n").alias("n"), F.array(*(quantile(q) for q in qs)).alias("q"))


def average_ranks(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rank`` within keys, ties sharing their mean, and ``ties``, the rows that share it. Rows with a null value or key are left out.

    Distinct values are ranked, not rows, so ties cost nothing; a band's values follow those of lower bands.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t")).withColumn("_b", band(F.col(value).cast("double")))
    placed = counts.join(before_bands(counts, keys).select(*keys, "_b", "_o"), [*keys, "_b"])
    before = F.sum("_t").over(Window.partitionBy(*keys, "_b").orderBy(value)) - F.col("_t")
    ranked = placed.withColumn("rank", F.col("_o") + before + (F.col("_t") + 1) / 2)
    return rows.join(ranked.select(*keys, value, "rank", F.col("_t").alias("ties")), [*keys, value])
