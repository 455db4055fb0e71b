"""Market statistics: outliers, ranks, tests, growth, yields, regressions, bootstrap."""
from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce
from math import atan, cos, erfc, exp, log, pi, sin, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import Stage, stage
from .market import money
from .quantiles import average_ranks, exact_quantiles, quantiles_of, value_counts


def with_group(rows: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates of each group beside its rows; one join, no window over a whole group."""
    return rows.join(rows.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items())), list(keys))


def fences(rows: DataFrame, value: str, keys: Sequence[str], *, k: float = 3.0, least: int = 10) -> DataFrame:
    """``outlier``: outside k times the interquartile range of the log, in groups of at least ``least`` positive values."""
    log_ = F.when(F.col(value) > 0, F.log(value))
    rows = with_group(rows.withColumn("_l", log_), keys, _n=F.count("_l"), _q=F.percentile("_l", F.array(F.lit(0.25), F.lit(0.75))))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    out = (F.col("_n") >= least) & ((F.col("_l") < q1 - k * (q3 - q1)) | (F.col("_l") > q3 + k * (q3 - q1)))
    return rows.withColumn("outlier", F.coalesce(out, F.lit(False))).drop("_l", "_n", "_q")


def below_group_median(rows: DataFrame, value: str, keys: Sequence[str], *, share: float, least: int = 10) -> DataFrame:
    """``low``: under ``share`` of the group's median, in groups of at least ``least``."""
    rows = with_group(rows, keys, _n=F.count(value), _m=F.median(value))
    return rows.withColumn("low", F.coalesce((F.col("_n") >= least) & (F.col(value) < share * F.col("_m")), F.lit(False))).drop("_n", "_m")


def flag_mixture(rows: DataFrame, value: str, keys: Sequence[str], *, least: int = 30, passes: int = 2, work: Stage | None = None) -> DataFrame:
    """``low``: the lower of two Gaussians on the log ratio to the group's upper quartile, refitted without what was flagged.

    A flag follows from group and value, so fits see each group's distinct values with their counts, and the rows are read once for these and once
    for the result. The quartiles, a row a group, are stored in ``work``, which the result reads. A null key is a group of its own.
    """
    work = work or Stage(rows.sparkSession)
    r, low = F.log(F.when(F.col("_v") > 0, F.col("_v")) / F.col("_q")), F.col("low")

    def beside(part: DataFrame, quartiles: DataFrame) -> DataFrame:
        named = quartiles.select(F.col("_q"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))
        return part.join(named, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))

    with stage(rows.sparkSession) as held:
        counts = held.store(value_counts(rows, value, keys), "counts")
        seen, rows = counts.withColumn("low", F.lit(False)), rows.withColumns({"low": F.lit(False), "_v": F.col(value).cast("double")})
        for _ in range(passes):
            found = quantiles_of(seen.where(~low), keys, [0.75]).where(F.col("n") >= least).select(*keys, F.col("q")[0].alias("_q")).where("_q > 0")
            quartiles = work.store(found, "quartiles")
            params = two_normals(held.store(beside(seen, quartiles).where(~low).select(r.alias("r"), F.col("_t").alias("n")).where("r is not null"), "ratios"), "r", "n")
            if not params:
                break
            score = lambda m, v, w: F.lit(log(w) - log(v) / 2) - F.pow(r - m, 2) / (2 * v)
            lower = low | F.coalesce((score(*params[0]) > score(*params[1])) & (r < params[1][0]), F.lit(False))
            seen, rows = (beside(part, quartiles).withColumn("low", lower).drop("_q") for part in (seen, rows))
    return rows.drop("_v")


#: Bins of the histogram on which a mixture is first fitted, for each unit.
BINS = 1024


def two_normals(rows: DataFrame, x: str, weight: str, *, rounds: int = 20, tolerance: float = 1e-6) -> list[tuple[float, float, float]]:
    """(mean, variance, weight) of two Gaussians, the lower first, by expectation maximisation until it settles; none without rows.

    It starts a deviation below and above the mean, and settles on a histogram's counts and means, which reach the driver (``BINS`` a unit). From there it goes on with
    rounds over all rows, an aggregation each, until no parameter moves by ``tolerance``: one or two as a rule.
    """
    value, n = F.col(x), F.col(weight)
    bins = rows.groupBy(F.floor(value * BINS)).agg(F.sum(n).cast("double").alias("n"), (F.sum(n * value) / F.sum(n)).alias("x")).select("n", "x").toPandas()
    if not len(bins):
        return []
    at, held = bins.x.to_numpy(), bins.n.to_numpy()
    total, mean = held.sum(), np.average(at, weights=held)
    spread = max(float(np.average((at - mean) ** 2, weights=held)), 1e-9)
    fit = np.array([(mean - sqrt(spread), spread, 0.5), (mean + sqrt(spread), spread, 0.5)])

    def moved(sums: np.ndarray) -> np.ndarray:
        """The next fit by each side's weight, and its sums of distances from the present mean and of their squares."""
        s, d, q = np.maximum(sums[:, 0], 1e-300), sums[:, 1], sums[:, 2]
        new = np.stack([fit[:, 0] + d / s, np.maximum(q / s - (d / s) ** 2, 1e-9), np.clip(s / total, 1e-9, 1)], 1)
        return np.where((sums[:, 0] > 1e-9 * total)[:, None], new, fit)

    for _ in range(20_000):
        score = [log(w) - log(v) / 2 - (at - m) ** 2 / (2 * v) for m, v, w in fit]
        lower = held / (1 + np.exp(np.minimum(score[1] - score[0], 700.0)))
        new = moved(np.array([[c.sum(), (c * (at - m)).sum(), (c * (at - m) ** 2).sum()] for c, m in zip((lower, held - lower), fit[:, 0], strict=True)]))
        done, fit = np.abs(new - fit).max() < tolerance / 1000, new
        if done:
            break
    for _ in range(rounds):
        a, b = (F.lit(log(w) - log(v) / 2) - F.pow(value - float(m), 2) / (2 * float(v)) for m, v, w in fit)
        lower = n / (1 + F.exp(F.least(b - a, F.lit(700.0))))
        sums = [F.sum(e) for c, m in zip((lower, n - lower), fit[:, 0].tolist(), strict=True) for e in (c, c * (value - m), c * F.pow(value - m, 2))]
        new = moved(np.array(list(rows.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first())).reshape(2, 3))
        done, fit = np.abs(new - fit).max() < tolerance, new
        if done:
            break
    return sorted(tuple(map(float, row)) for row in fit)


def mann_whitney(rows: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """n_a, n_b, u (of a), delta (Cliff's), z and p by the normal approximation with ties."""
    both = rows.where(F.col(group).isin(a, b)).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    ranked = average_ranks(both.withColumn("k", F.lit(0)), "v", ["k"])
    out = ranked.agg(
        F.count_if(F.col("g") == a).alias("n_a"), F.count_if(F.col("g") == b).alias("n_b"), F.sum(F.when(F.col("g") == a, F.col("rank"))).alias("r"),
        F.sum(F.col("ties") * F.col("ties") - 1).cast("double").alias("t"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("r") - na * (na + 1) / 2
    var = na * nb / 12 * ((n + 1) - F.try_divide(F.col("t"), n * (n - 1)))
    z = F.try_divide(u - na * nb / 2, F.sqrt(var))
    return out.select("n_a", "n_b", u.alias("u"), (2 * u / (na * nb) - 1).alias("delta"), z.alias("z")).withColumn("p", normal_p(F.col("z")))


#: The coefficients of a rational approximation of the error function whose error is below 1.5e-7.
ERF_SCALE, ERF_TERMS = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc_column(x: Column) -> Column:
    """Complementary error function of a number of 0 or more."""
    t = 1 / (1 + ERF_SCALE * x)
    series = F.lit(0.0)
    for a in reversed(ERF_TERMS):
        series = (series + a) * t
    return series * F.exp(-x * x)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value."""
    return erfc_column(F.abs(z) / sqrt(2))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of chi squared: a finite sum for even ``df``, with the normal tail before it for odd."""
    half = x / 2
    odd = df % 2 == 1
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(df / 2).cast("int")))
    # Terms half^i / i! from i = 0, or half^(i - 1/2) / gamma(i + 1/2) from i = 1; each is the one before times half / i, or half / (i - 1/2).
    first = F.when(odd, F.sqrt(half) / (sqrt(pi) / 2)).otherwise(F.lit(1.0))
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    grown = F.aggregate(steps, start, lambda a, i: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * half / F.when(odd, i + 0.5).otherwise(i.cast("double"))).alias("term")))
    tail = F.exp(-half) * F.when(df > 1, grown["sum"]).otherwise(0.0)
    return F.when(odd, erfc_column(F.sqrt(half)) + tail).otherwise(tail)


#: Residential types, and bounds of areas and of sale and monthly prices, that the market statistics take as plausible.
RESIDENTIAL = ("APARTMENT", "VILLA", "TOWNHOUSE", "STUDIO")
AREA_BOUNDS, SALE_BOUNDS, RENT_BOUNDS = (30, 2_000), (100_000, 2_000_000_000), (500, 1_000_000)


def plausible(rows: DataFrame) -> DataFrame:
    """Residential rows whose price is plausible for their listing type; an area out of bounds becomes null. Nulls aren't plausible."""
    sale, rent = (F.col("listing_type") == kind for kind in ("SALE", "RENT"))
    fair = (sale & F.col("price").between(*SALE_BOUNDS)) | (rent & F.col("price").between(*RENT_BOUNDS))
    return rows.where(F.col("property_type").isin(*RESIDENTIAL) & fair).withColumn("area_sqm", F.when(F.col("area_sqm").between(*AREA_BOUNDS), F.col("area_sqm")))


def kruskal(rows: DataFrame, value: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """H with the correction for ties, epsilon squared, p by chi squared, groups and n of each key."""
    base = rows.where(F.col(value).isNotNull()).withColumn("_k", F.lit(0))
    keys = [*keys] or ["_k"]
    ranked = average_ranks(base, value, keys)
    per = ranked.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"), F.sum(F.col("ties") * F.col("ties") - 1).alias("t"))
    total = per.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("t").cast("double").alias("t"), F.count(F.lit(1)).alias("groups"))
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(F.col("t"), n * n * n - n))
    return total.select(*(k for k in keys if k != "_k"), F.col("n").cast("long").alias("n"), "groups", h.alias("h"), F.try_divide(h, n - 1).alias("epsilon2"), chi2_p(h, F.col("groups") - 1).alias("p"))


def _range_of(value: Column, cuts: Sequence, first: int = 0) -> Column:
    """Number of the cuts below a value, by halving."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(value <= cuts[m], _range_of(value, cuts[:m], first)).otherwise(_range_of(value, cuts[m + 1 :], first + m + 1))


def ranges(rows: DataFrame, value: str) -> Column:
    """Range of a value, of about as many as shuffles have partitions, with like numbers of rows. The same for equal values."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return F.lit(0)
    cuts = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]  # parts - 1 values
    return _range_of(F.col(value), sorted(set(cuts or [])))


def holm(rows: DataFrame, p: str, order: Sequence[str]) -> DataFrame:
    """``p_holm``: step-down correction over all rows (one a hypothesis).

    Equal p get the same: the first of them has the largest step. So distinct p are ranked, in ranges of p; what goes from range to
    range (counts, largest steps) passes the driver, a number a range.
    """
    rows = rows.where(F.col(p).isNotNull())
    counts = rows.groupBy(p).agg(F.count(F.lit(1)).alias("_t")).withColumn("_b", ranges(rows, p))
    totals = dict(counts.groupBy("_b").agg(F.sum("_t")).collect())
    m, offset, seen = sum(totals.values()), {}, 0
    for b in sorted(totals):
        offset[b], seen = seen, seen + totals[b]
    of = lambda found: F.element_at(F.create_map(*(F.lit(x) for kv in found.items() for x in kv)), F.col("_b")) if found else F.lit(0)
    w = Window.partitionBy("_b").orderBy(p)
    before = of(offset) + F.coalesce(F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (m - before)))
    highs, high, so_far = dict(steps.groupBy("_b").agg(F.max("_s")).collect()), {}, 0.0
    for b in sorted(highs):
        high[b], so_far = so_far, max(so_far, highs[b])
    held = F.greatest(of(high), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.join(steps.select(p, held.alias("p_holm")), p)


def verdict(p: Column, effect: Column) -> Column:
    return F.when(p.isNull() | (p >= 0.05), "no difference").when(F.abs(effect) < 0.06, "small").when(F.abs(effect) < 0.14, "medium").otherwise("large")


def medians(rows: DataFrame, value: str, keys: Sequence[str], least: int = 1) -> DataFrame:
    return exact_quantiles(rows, value, keys, (0.5,)).select(*keys, "n", money(F.col("q")[0]).alias("median")).where(F.col("n") >= least)


def _two_years(rows: DataFrame, value: str, key: str, year: Column, y0: int, y1: int) -> DataFrame:
    """key, n0, n1, m0, m1: values of two years and their medians; null where a year has none."""
    of = exact_quantiles(rows.withColumn("_y", year).where(F.col("_y").isin(y0, y1)), value, [key, "_y"], (0.5,))
    side = lambda y, what: F.max(F.when(F.col("_y") == y, what))
    return of.groupBy(key).agg(side(y0, F.col("n")).alias("n0"), side(y1, F.col("n")).alias("n1"), side(y0, F.col("q")[0]).alias("m0"), side(y1, F.col("q")[0]).alias("m1"))


def growth(rows: DataFrame, value: str, key: str, year: Column, y0: int, y1: int, least: int = 20) -> DataFrame:
    """Medians of two years side by side, multiple and yearly growth, where both have ``least`` values."""
    wide = _two_years(rows, value, key, year, y0, y1).select(key, *(c for i, y in enumerate((y0, y1)) for c in (F.col(f"n{i}").alias(f"n_{y}"), money(F.col(f"m{i}")).alias(f"m_{y}"))))
    times = F.col(f"m_{y1}") / F.col(f"m_{y0}")
    return wide.where((F.col(f"n_{y0}") >= least) & (F.col(f"n_{y1}") >= least)).withColumns({"multiple": F.round(times, 6), "cagr": F.round(F.pow(times, F.lit(1 / (y1 - y0))) - 1, 6)})


def movers(rows: DataFrame, value: str, key: str, year: Column, y0: int, y1: int, least: int = 40) -> DataFrame:
    """Change of each key's median from one year to another, where both have ``least`` values, the largest first."""
    wide = _two_years(rows, value, key, year, y0, y1)
    return wide.where((F.col("n0") >= least) & (F.col("n1") >= least)).withColumn("change", F.col("m1") / F.col("m0") - 1).orderBy(F.desc("change"), key)


def ranking(rows: DataFrame, value: str, key: str, least: int) -> DataFrame:
    """Keys with ``least`` values from the highest median."""
    m = medians(rows, value, [key], least)
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("median"), key)).cast("long"))


def rental_yield(sale: DataFrame, rent: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Twelve monthly medians over the sale median."""
    s = medians(sale, value, keys).select(*keys, F.col("median").alias("sale"))
    r = medians(rent, value, keys).select(*keys, F.col("median").alias("rent"))
    return s.join(r, list(keys)).withColumn("yield", F.round(F.try_divide(12 * F.col("rent"), F.col("sale")), 6))


def heat(rows: DataFrame, key: str, quarter: Column, axis: Sequence[str]) -> DataFrame:
    """Counts by key, a column for each quarter of the axis, 0 where there are none."""
    wide = rows.groupBy(key).pivot("_q", list(axis)) if "_q" in rows.columns else rows.withColumn("_q", quarter).groupBy(key).pivot("_q", list(axis))
    out = wide.agg(F.count(F.lit(1)))
    return out.select(key, *(F.coalesce(F.col(f"`{q}`"), F.lit(0).cast("long")).alias(q.lower()) for q in axis))


def share(rows: DataFrame, flag: Column, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(flag.cast("double")), 6).alias("share"))


def crosstab(rows: DataFrame, a: Column, b: Column) -> dict[str, float]:
    """2x2 table, chi squared, odds ratio with 95 % bounds (half added to each cell where one is empty)."""
    cells = {(r[0], r[1]): r[2] for r in rows.groupBy(a.alias("a"), b.alias("b")).count().collect()}
    n11, n10, n01, n00 = (float(cells.get(k, 0)) for k in ((True, True), (True, False), (False, True), (False, False)))
    n = n11 + n10 + n01 + n00
    margin = (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)
    chi2 = n * (n11 * n00 - n10 * n01) ** 2 / margin if margin else 0.0
    c = [x + 0.5 if min(n11, n10, n01, n00) == 0 else x for x in (n11, n10, n01, n00)]
    ratio, se = c[0] * c[3] / (c[1] * c[2]), sqrt(sum(1 / x for x in c))
    return {"n11": n11, "n10": n10, "n01": n01, "n00": n00, "chi2": chi2, "odds_ratio": ratio, "low": exp(log(ratio) - 1.96 * se), "high": exp(log(ratio) + 1.96 * se)}


@lru_cache(maxsize=256)
def _median_ranks(n: int, seed: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (from 0, of n sorted values) of the two middle values of each resample of n values; the same twice where n is odd.

    A resample's ranks are n uniform numbers, scaled and cut down, so its k-th is one of a beta distribution; the next above is the
    least of the n - k that are left.
    """
    rng = np.random.default_rng(seed & ((1 << 64) - 1))
    k = (n + 1) // 2
    u = rng.beta(k, n - k + 1, draws)
    v = u if n % 2 else u + (1 - u) * rng.beta(1, n - k, draws)
    return tuple(np.minimum((x * n).astype(np.int64), n - 1) for x in (u, v))


def median_draws(rows: DataFrame, value: str, keys: Sequence[str], *, draws: int = 2000, seed: int = 7, least: int = 1) -> DataFrame:
    """n, the exact median and the medians of ``draws`` seeded resamples (``draws``, an array) of each group of ``least`` values.

    The resampled medians' ranks are drawn from n alone, and the values at these ranks looked up among the group's sorted values. Those
    are ranked in ranges of the value; only the values between the least and the largest rank drawn, some sqrt(n), meet in a task.
    Groups and seeds draw independently.
    """
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_t"))
    counts = counts.withColumn("_b", ranges(counts, "_v"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def offsets(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_b")
        n = int(part["_c"].sum())
        if n < least:
            part = part[:0]
        after = part["_c"].cumsum()
        one, two = _median_ranks(n, int(part["_seed"].iloc[0]), draws) if len(part) else (np.zeros(1), np.zeros(1))
        low, high = min(one.min(), (n - 1) // 2), max(two.max(), n // 2)
        out = part.assign(_o=after - part["_c"], n=n, _low=low, _high=high)
        return out[(after > low) & (out["_o"] <= high)][[*keys, "_b", "_o", "n", "_low", "_high", "_seed"]]

    totals = counts.groupBy(*keys, "_b").agg(F.sum("_t").alias("_c")).withColumn("_seed", F.xxhash64(*keys, F.lit(seed)))
    where = totals.groupBy(*keys).applyInPandas(offsets, f"{kinds}, _b int, _o long, n long, _low long, _high long, _seed long")
    same = F.col("c._b") == F.col("o._b")
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}"))
    near = counts.alias("c").join(where.alias("o"), same).select(*(F.col(f"c.{k}").alias(k) for k in keys), "_v", "_t", "c._b", "_o", "n", "_low", "_high", "_seed")
    before = F.sum("_t").over(Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("_o", F.col("_o") + F.coalesce(before, F.lit(0))).where((F.col("_o") <= F.col("_high")) & (F.col("_o") + F.col("_t") > F.col("_low")))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_o")
        v, o, n = part["_v"].to_numpy(), part["_o"].to_numpy(), int(part["n"].iloc[0])
        at = lambda ranks: v[np.searchsorted(o, ranks, "right") - 1]
        one, two = _median_ranks(n, int(part["_seed"].iloc[0]), draws)
        middle = float(at((n - 1) // 2) + at(n // 2)) / 2
        return pd.DataFrame([[*key, n, middle, ((at(one) + at(two)) / 2).tolist()]], columns=[*keys, "n", "median", "draws"])

    return near.select(*keys, "_v", "_o", "n", "_seed").groupBy(*keys).applyInPandas(run, f"{kinds}, n long, median double, draws array<double>")


def quantile(values: Column, q: float) -> Column:
    """Quantile of an array by linear interpolation."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = (F.get(F.array_sort(values), i) for i in (low, F.ceil(at).cast("int")))
    return a + (b - a) * (at - low)


def bootstrap_median(rows: DataFrame, value: str, keys: Sequence[str], **options) -> DataFrame:
    """n, median and its 95 % bounds of each group, by a seeded bootstrap."""
    d = F.col("draws")
    return median_draws(rows, value, keys, **options).select(*keys, "n", "median", quantile(d, 0.025).alias("low"), quantile(d, 0.975).alias("high"))


def ratio_draws(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str], *, seed: int = 7, **options) -> DataFrame:
    """Ratio of two medians, and its ``draws`` from independent resamples of both sides."""
    one = median_draws(a, value, keys, seed=seed, **options).select(*keys, F.col("median").alias("_ma"), F.col("draws").alias("_da"))
    two = median_draws(b, value, keys, seed=seed + 1, **options).select(*keys, F.col("median").alias("_mb"), F.col("draws").alias("_db"))
    return one.join(two, list(keys)).select(*keys, F.try_divide("_ma", "_mb").alias("ratio"), F.zip_with("_da", "_db", lambda x, y: F.try_divide(x, y)).alias("draws"))


def ratio_bounds(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str], **options) -> DataFrame:
    """Ratio of two medians with its 95 % bounds from independent resamples of both."""
    d = F.col("draws")
    return ratio_draws(a, b, value, keys, **options).select(*keys, "ratio", quantile(d, 0.025).alias("low"), quantile(d, 0.975).alias("high"))


def yield_difference(rent: DataFrame, sale: DataFrame, value: str, keys: Sequence[str], place: str, one: str, two: str, **options) -> DataFrame:
    """Yield (12 * rent / sale) of place ``one`` less that of ``two`` by keys: median of the draws, its 95 % bounds, two-sided bootstrap p."""
    both = [x.where(F.col(place).isin(one, two)) for x in (rent, sale)]
    draws = ratio_draws(*both, value, [*keys, place], **options)
    side = lambda p, name: draws.where(F.col(place) == p).select(*keys, F.col("draws").alias(name))
    d = F.col("d")
    share = lambda hit: F.size(F.filter(d, hit)) / F.size(d)
    p = F.least(F.lit(1.0), 2 * F.least(share(lambda x: x <= 0), share(lambda x: x >= 0)))
    found = side(one, "_1").join(side(two, "_2"), list(keys)).select(*keys, F.zip_with("_1", "_2", lambda x, y: 12 * (x - y)).alias("d"))
    return found.select(*keys, quantile(d, 0.5).alias("difference"), quantile(d, 0.025).alias("low"), quantile(d, 0.975).alias("high"), p.alias("p"))


def gram(rows: DataFrame, x: Sequence[str], y: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X and X'y in one aggregation; an intercept comes first. What leaves the cluster is quadratic in the columns only."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    w = weight if weight is not None else F.lit(1.0)
    k = len(cols)
    aggs = [F.sum(w * cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * c * F.col(y).cast("double")) for c in cols] + [F.count(F.lit(1))]
    got = list(rows.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).first())
    xx = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = got[at] or 0.0
            at += 1
    return xx, np.array([v or 0.0 for v in got[at : at + k]]), int(got[-1])


def ols(rows: DataFrame, x: Sequence[str], y: str, *, cluster: str | None = None) -> pd.DataFrame:
    """Coefficients with HC3 errors, or with errors clustered by a column; z and p by the normal approximation.

    Two passes: the normal equations, then the residuals' meat. Rows with a null are left out.
    """
    rows = rows.na.drop(subset=[*x, y])
    xx, xy, n = gram(rows, x, y)
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    k = len(cols)
    fit = sum((float(b) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
    e = F.col(y).cast("double") - fit
    if cluster:
        scores = rows.groupBy(cluster).agg(*(F.sum(c * e).alias(f"s{i}") for i, c in enumerate(cols)), F.count(F.lit(1)).alias("_n"))
        got = list(scores.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i in range(k) for j in range(i, k)), F.count(F.lit(1))).first())
        groups = int(got[-1])
        scale = groups / max(1, groups - 1) * (n - 1) / max(1, n - k)
    else:
        # Leverage is x inv x: the square of x times a root of inv. Values that many sums use are columns of their own, so that each is worked out once a row.
        values, vectors = np.linalg.eigh(inv)
        root = vectors * np.sqrt(np.maximum(values, 0))
        turned = [sum((float(root[i, j]) * cols[i] for i in range(k)), F.lit(0.0)) for j in range(k)]
        held = rows.select(*(c.alias(f"_c{i}") for i, c in enumerate(cols)), F.pow(e / (1 - sum((t * t for t in turned), F.lit(0.0))), 2).alias("_w"))
        c = [F.col(f"_c{i}") for i in range(k)]
        got = list(held.agg(*(F.sum(F.col("_w") * c[i] * c[j]) for i in range(k) for j in range(i, k))).first())
        scale = 1.0
    meat = np.zeros((k, k))
    at = 0
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = got[at] or 0.0
            at += 1
    cov = scale * inv @ meat @ inv
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    z = np.divide(beta, se, out=np.full(k, np.nan), where=se > 0)
    out = pd.DataFrame({"term": ["intercept", *x], "beta": beta, "se": se, "z": z, "p": [erfc(abs(v) / sqrt(2)) for v in z]})
    out.attrs |= {"cov": cov, "n": n}
    return out


def wald(fit: pd.DataFrame, terms: Sequence[str]) -> tuple[float, int]:
    """Statistic and degrees of freedom that all ``terms`` are zero."""
    i = [fit.index[fit.term == t][0] for t in terms]
    b, v = fit.beta.to_numpy()[i], fit.attrs["cov"][np.ix_(i, i)]
    return float(b @ np.linalg.pinv(v) @ b), len(i)


def combination(fit: pd.DataFrame, weights: dict[str, float]) -> tuple[float, float, float]:
    """A linear combination of coefficients with its 95 % bounds: predictions and premiums."""
    a = np.array([weights.get(t, 0.0) for t in fit.term])
    value, se = float(a @ fit.beta.to_numpy()), float(np.sqrt(max(a @ fit.attrs["cov"] @ a, 0)))
    return value, value - 1.96 * se, value + 1.96 * se


def median_regression(rows: DataFrame, x: Sequence[str], y: str, *, rounds: int = 12, floor: float = 1e-4) -> pd.DataFrame:
    """Least absolute deviations by reweighted least squares, one aggregation a round."""
    rows = rows.na.drop(subset=[*x, y])
    xx, xy, _ = gram(rows, x, y)
    beta = np.linalg.pinv(xx) @ xy
    for _ in range(rounds):
        fit = sum((float(b) * c for b, c in zip(beta, [F.lit(1.0), *(F.col(c).cast("double") for c in x)], strict=True)), F.lit(0.0))
        xx, xy, _ = gram(rows, x, y, 1 / F.greatest(F.abs(F.col(y).cast("double") - fit), F.lit(floor)))
        beta = np.linalg.pinv(xx) @ xy
    return pd.DataFrame({"term": ["intercept", *x], "beta": beta})


def student_p(t: float, df: int) -> float:
    """Two-sided p of Student's t with a whole number of degrees of freedom."""
    if np.isnan(t):
        return float("nan")
    angle = atan(abs(t) / sqrt(df))
    c, term, total = cos(angle) ** 2, 1.0, 0.0
    for i in range(df // 2):
        total += term
        term *= c * ((2 * i + 2) / (2 * i + 3) if df % 2 else (2 * i + 1) / (2 * i + 2))
    inside = 2 / pi * (angle + sin(angle) * cos(angle) * total) if df % 2 else sin(angle) * total
    return max(0.0, 1 - inside)


def paired_t(a: Sequence[float], b: Sequence[float]) -> tuple[float, float]:
    """t and two-sided p that two scores of the same folds have one mean."""
    d = np.asarray(a, float) - np.asarray(b, float)
    if len(d) < 2 or not d.std(ddof=1):
        return float("nan"), float("nan")
    t = float(d.mean() / (d.std(ddof=1) / sqrt(len(d))))
    return t, student_p(t, len(d) - 1)


def positions(rows: DataFrame, order: Column, name: str, within: Column | None = None, groups: int = 1) -> DataFrame:
    """``name``: the rows numbered from 0 in the order of a hash, in ranges of it. The ranges' counts pass the driver.

    ``within``, a number below ``groups``, comes before the hash: a group's rows are numbered in one run.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = within.cast("int") * parts if within is not None else F.lit(0)
    rows = rows.withColumn("_h", order).withColumn("_b", lead + F.floor((F.shiftrightunsigned("_h", 33) * parts) / (1 << 31)).cast("int"))
    counts = dict(rows.groupBy("_b").count().collect())
    begins = np.cumsum([0, *(counts.get(b, 0) for b in range(groups * parts - 1))]).tolist()
    first = F.get(F.array(*map(F.lit, begins)), F.col("_b"))
    return rows.withColumn(name, first + F.row_number().over(Window.partitionBy("_b").orderBy("_h")) - 1).drop("_h", "_b")


def dealt(rows: DataFrame, columns: Sequence[str], by: Sequence[str], seed: int, within: str | None = None, groups: int = 1) -> DataFrame:
    """``rows`` with ``_s_c``, the values of each column c dealt out anew, inside the groups of ``within``: two orders by hash are joined at each place."""
    lead = F.col(within) if within else None
    a = positions(rows, F.xxhash64(*by, F.lit(seed)), "_i", lead, groups)
    b = positions(rows.select(*by, *([within] if within else [])), F.xxhash64(*by, F.lit(seed + 1)), "_i", lead, groups)
    return a.join(b.select("_i", *(F.col(c).alias(f"_s_{c}") for c in columns)), "_i").drop("_i")


def shuffled(rows: DataFrame, column: str, by: Sequence[str], seed: int) -> DataFrame:
    """``rows`` with the values of one column dealt out anew."""
    return dealt(rows, [column], by, seed).withColumn(column, F.col(f"_s_{column}")).drop(f"_s_{column}")


def boosted(rows: DataFrame, x: Sequence[str], y: str, *, folds: int = 5, seed: int = 3, iterations: int = 20) -> pd.DataFrame:
    """Cross-validated R squared of gradient boosting, and the loss of it when one feature is shuffled.

    ``r2_less`` is the R squared without the last feature, ``t`` and ``p`` (the same in each row) the paired t test of the folds' two scores.
    Rows of one fold and equal features are a cell: the trees' squared errors follow from its count and mean, R squared from its sums, so fits and scores see the cells. All folds are
    shuffled at once, each within itself.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    value = F.col("_y")
    sums = (F.count(F.lit(1)).cast("double").alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("ss"))
    features = [f"_x{i}" for i in range(len(x))]
    loss = F.sum(F.col("ss") - 2 * F.col("prediction") * F.col("s") + F.col("n") * F.pow("prediction", 2))
    r2 = (1 - loss / (F.sum("ss") - F.pow(F.sum("s"), 2) / F.sum("n"))).alias("r2")
    out = []
    with stage(rows.sparkSession) as work:
        rows = rows.select(*x, y).na.drop().withColumn("_fold", F.pmod(F.xxhash64(*x, y, F.lit(seed)), F.lit(folds))).withColumn("_y", F.col(y).cast("double"))
        rows = work.store(rows, "rows")
        cells = work.store(rows.groupBy("_fold", *(F.col(c).cast("double").alias(f) for c, f in zip(x, features, strict=True))).agg(*sums), "cells")
        # A row's features with one of them from another row, for each of them.
        swaps = [F.struct(F.lit(c).alias("swapped"), *(F.col(f"_s_{o}" if o == c else o).cast("double").alias(f) for o, f in zip(x, features, strict=True))) for c in x]
        swapped = dealt(rows, x, [*x, y], seed, "_fold", folds).select("_fold", "_y", F.explode(F.array(*swaps)).alias("to")).select("_fold", "_y", "to.*")
        swapped = work.store(swapped.groupBy("_fold", "swapped", *features).agg(*sums), "swapped")
        for fold in range(folds):

            def model(used: Sequence[str], fold=fold):
                train = cells.where(F.col("_fold") != fold).groupBy(*used).agg((F.sum("s") / F.sum("n")).alias("_mean"), F.sum("n").alias("n"))
                assemble = VectorAssembler(inputCols=list(used), outputCol="_x")
                fit = GBTRegressor(featuresCol="_x", labelCol="_mean", weightCol="n", maxIter=iterations, seed=seed).fit(assemble.transform(train))
                return lambda part: fit.transform(assemble.transform(part.where(F.col("_fold") == fold)))

            whole = model(features)
            base = whole(cells).agg(r2).first().r2
            row = {"fold": fold, "r2": base, "r2_less": model(features[:-1])(cells).agg(r2).first().r2 if len(x) > 1 else 0.0}
            after = dict(whole(swapped).groupBy("swapped").agg(r2).collect())  # a row a feature
            out.append(row | {f"importance_{c}": base - after[c] for c in x})
    t, p = paired_t([r["r2"] for r in out], [r["r2_less"] for r in out])
    return pd.DataFrame(out).assign(t=t, p=p)
