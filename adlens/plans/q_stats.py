"""Statistics queries over the listing views."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import stats as S
from ..sources.staging import fresh
from ..sources.views import table
from .registry import query

_BASE = "base AS (SELECT l_orderkey AS id, p_brand AS brand, p_type AS kind, l_returnflag AS flag, year(l_shipdate) AS y, quarter(l_shipdate) AS q, l_extendedprice / l_quantity AS v, l_quantity AS qty, l_discount AS disc, l_shipdate AS at FROM lineitem JOIN part ON p_partkey = l_partkey)"


def base(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("id"), "brand", "kind", F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_shipdate").alias("at"),
    )


_MED = "CAST(round(CAST(median(v) AS DECIMAL(24,6)), 2) AS DOUBLE)"


@query("tukey_outliers", f"WITH {_BASE}, g AS (SELECT brand, y, count(*) AS n, quantile_cont(ln(v), 0.25) AS a, quantile_cont(ln(v), 0.75) AS b FROM base WHERE v > 0 GROUP BY ALL) SELECT base.brand, CAST(count(*) FILTER (n >= 10 AND (ln(v) < a - 1.5 * (b - a) OR ln(v) > b + 1.5 * (b - a))) AS BIGINT) AS outliers FROM base JOIN g USING (brand, y) GROUP BY 1")
def tukey_outliers(spark, d):
    return S.fences(base(spark, d), "v", ["brand", "y"], k=1.5).groupBy("brand").agg(F.count_if("outlier").alias("outliers"))


@query("below_median", f"WITH {_BASE}, g AS (SELECT kind, count(v) AS n, median(v) AS m FROM base GROUP BY 1) SELECT kind, CAST(count(*) FILTER (n >= 10 AND v < 0.25 * m) AS BIGINT) AS low FROM base JOIN g USING (kind) GROUP BY 1")
def below_median(spark, d):
    return S.below_group_median(base(spark, d), "v", ["kind"], share=0.25).groupBy("kind").agg(F.count_if("low").alias("low"))


@query("mixture_flags")
def mixture_flags(spark, d):
    return S.flag_mixture(base(spark, d), "v", ["kind"], work=fresh(spark, "mixture_flags")).groupBy("kind").agg(F.count_if("low").alias("low"), F.count(F.lit(1)).alias("n"))


@query("median_by_group", f"WITH {_BASE} SELECT brand, y, count(v) AS n, {_MED} AS median FROM base GROUP BY ALL HAVING count(v) >= 20")
def median_by_group(spark, d):
    return S.medians(base(spark, d), "v", ["brand", "y"], 20)


@query("market_ranking", f"WITH {_BASE}, m AS (SELECT brand, count(v) AS n, {_MED} AS median FROM base GROUP BY 1 HAVING count(v) >= 250) SELECT *, row_number() OVER (ORDER BY median DESC, brand) AS rank FROM m")
def market_ranking(spark, d):
    return S.ranking(base(spark, d), "v", "brand", 250)


_G = ", ".join(f"count(CASE WHEN y = {y} THEN v END) AS n_{y}, CAST(round(CAST(median(CASE WHEN y = {y} THEN v END) AS DECIMAL(24,6)), 2) AS DOUBLE) AS m_{y}" for y in (1996, 2000))


@query("growth_cagr", f"WITH {_BASE}, g AS (SELECT brand, {_G} FROM base WHERE y IN (1996, 2000) GROUP BY 1) SELECT *, round(m_2000 / m_1996, 6) AS multiple, round(pow(m_2000 / m_1996, 1 / 4.0) - 1, 6) AS cagr FROM g WHERE n_1996 >= 40 AND n_2000 >= 40")
def growth_cagr(spark, d):
    return S.growth(base(spark, d), "v", "brand", F.col("y"), 1996, 2000, 40)


@query("rental_yield", f"WITH {_BASE}, s AS (SELECT kind, y, {_MED} AS sale FROM base WHERE flag = 'N' GROUP BY ALL), r AS (SELECT kind, y, {_MED} AS rent FROM base WHERE flag = 'A' GROUP BY ALL) SELECT kind, y, sale, rent, round(12 * rent / sale, 6) AS yield FROM s JOIN r USING (kind, y)")
def rental_yield(spark, d):
    b = base(spark, d)
    return S.rental_yield(b.where("flag = 'N'"), b.where("flag = 'A'"), "v", ["kind", "y"])


@query("rental_yield_matched", f"WITH {_BASE}, b AS (SELECT * FROM base WHERE qty BETWEEN 10 AND 30), s AS (SELECT kind, {_MED} AS sale FROM b WHERE flag = 'N' GROUP BY ALL), r AS (SELECT kind, {_MED} AS rent FROM b WHERE flag = 'A' GROUP BY ALL) SELECT kind, sale, rent, round(12 * rent / sale, 6) AS yield FROM s JOIN r USING (kind)")
def rental_yield_matched(spark, d):
    b = base(spark, d).where("qty between 10 and 30")
    return S.rental_yield(b.where("flag = 'N'"), b.where("flag = 'A'"), "v", ["kind"])


_RANKED = f"WITH {_BASE}, r AS (SELECT *, rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY qty) AS t FROM base WHERE flag IN ('A', 'N'))"


@query("mann_whitney", _RANKED + """, s AS (SELECT CAST(count(*) FILTER (flag = 'A') AS DOUBLE) AS a, CAST(count(*) FILTER (flag = 'N') AS DOUBLE) AS b, sum(CASE WHEN flag = 'A' THEN rk END) AS r, CAST(sum(t * t - 1) AS DOUBLE) AS t FROM r),
  u AS (SELECT *, r - a * (a + 1) / 2 AS u FROM s)
  SELECT CAST(a AS BIGINT) AS n_a, CAST(b AS BIGINT) AS n_b, u, round(2 * u / (a * b) - 1, 9) AS delta, round(z, 6) AS z, round((((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k) * exp(-z * z / 2), 6) AS p
  FROM (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS k FROM (SELECT *, (u - a * b / 2) / sqrt(a * b / 12 * ((a + b + 1) - t / ((a + b) * (a + b - 1)))) AS z FROM u))""")
def mann_whitney(spark, d):
    return S.mann_whitney(base(spark, d), "qty", "flag", "A", "N").select("n_a", "n_b", "u", F.round("delta", 9).alias("delta"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


_KW = f"""WITH {_BASE}, r AS (SELECT *, rank() OVER (PARTITION BY y ORDER BY qty) + (count(*) OVER (PARTITION BY y, qty) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY y, qty) AS t FROM base),
  g AS (SELECT y, kind, count(*) AS n, sum(rk) AS r, sum(t * t - 1) AS t FROM r GROUP BY ALL),
  s AS (SELECT y, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS s, CAST(sum(t) AS DOUBLE) AS t, count(*) AS groups FROM g GROUP BY 1),
  h AS (SELECT y, CAST(n AS BIGINT) AS n, groups, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM s)"""


@query("kruskal_wallis", _KW + " SELECT y, n, groups, round(h, 5) AS h, round(h / (n - 1), 8) AS epsilon2 FROM h")
def kruskal_wallis(spark, d):
    return S.kruskal(base(spark, d), "qty", "kind", ["y"]).select("y", "n", "groups", F.round("h", 5).alias("h"), F.round("epsilon2", 8).alias("epsilon2"))


@query("holm_correction", "WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 1000) / 20000.0 AS p FROM part), s AS (SELECT *, least(1.0, p * ((SELECT count(*) FROM p) - row_number() OVER (ORDER BY p, id) + 1)) AS s FROM p) SELECT id, CAST(p AS DOUBLE) AS p, CAST(max(s) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS p_holm FROM s")
def holm_correction(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 % 1000) / 20000).alias("p"))
    return S.holm(rows, "p", ["id"]).select("id", "p", "p_holm")


@query("holm_correction_all", "WITH p AS (SELECT p_partkey AS id, (p_partkey * 37 % 1000) / 20000.0 AS p FROM part), s AS (SELECT *, least(1.0, p * ((SELECT count(*) FROM p) - row_number() OVER (ORDER BY p, id) + 1)) AS s FROM p) SELECT id, CAST(p AS DOUBLE) AS p, CAST(max(s) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS p_holm FROM s")
def holm_correction_all(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 37 % 1000) / 20000).alias("p"))
    return S.holm(rows, "p", ["id"]).select("id", "p", "p_holm")


@query("verdicts", "SELECT CASE WHEN l_discount >= 0.05 THEN 'no difference' WHEN l_tax < 0.06 THEN 'small' WHEN l_tax < 0.14 THEN 'medium' ELSE 'large' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1")
def verdicts(spark, d):
    return table(spark, d, "lineitem").groupBy(S.verdict(F.col("l_discount"), F.col("l_tax")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("share_by_group", f"WITH {_BASE} SELECT brand, flag, count(*) AS n, round(avg(CASE WHEN qty > 25 THEN 1.0 ELSE 0.0 END), 6) AS share FROM base GROUP BY ALL")
def share_by_group(spark, d):
    return S.share(base(spark, d), F.col("qty") > 25, ["brand", "flag"])


@query("coverage_heat", f"WITH {_BASE} SELECT brand, {', '.join(f'count(*) FILTER (y = 1997 AND q = {i}) AS q{i}' for i in range(1, 5))} FROM base WHERE y = 1997 GROUP BY 1")
def coverage_heat(spark, d):
    return S.heat(base(spark, d).where("y = 1997"), "brand", F.concat(F.lit("Q"), F.col("q").cast("string")), ["Q1", "Q2", "Q3", "Q4"])


def _steps(rows):
    from pyspark.sql import Window

    m = rows.select(F.col("l_suppkey").alias("k"), M.bucket(F.col("l_shipdate"), "month").alias("month")).distinct()
    before = F.lag("month").over(Window.partitionBy("k").orderBy("month"))
    return m.select("k", "month", before.alias("before"), F.coalesce(before < F.col("month") - F.expr("INTERVAL 1 MONTH"), F.lit(False)).alias("gap"))


@query("period_steps", "WITH m AS (SELECT DISTINCT l_suppkey AS k, date_trunc('month', l_shipdate)::TIMESTAMP AS month FROM lineitem) SELECT k, month, lag(month) OVER (PARTITION BY k ORDER BY month) AS before, coalesce(lag(month) OVER (PARTITION BY k ORDER BY month) < month - INTERVAL 1 MONTH, false) AS gap FROM m")
def period_steps(spark, d):
    return _steps(table(spark, d, "lineitem"))


@query("period_steps_all", "WITH m AS (SELECT DISTINCT l_suppkey AS k, date_trunc('month', l_shipdate)::TIMESTAMP AS month FROM lineitem) SELECT k, month, lag(month) OVER (PARTITION BY k ORDER BY month) AS before, coalesce(lag(month) OVER (PARTITION BY k ORDER BY month) < month - INTERVAL 1 MONTH, false) AS gap FROM m")
def period_steps_all(spark, d):
    return _steps(table(spark, d, "lineitem"))


@query("place_classes", "SELECT CASE WHEN contains(p_name, 'ring') THEN 'rehab' WHEN contains(p_name, 'widget') THEN 'madinaty' WHEN contains(p_name, 'small') THEN 'mostakbal' ELSE coalesce(CASE WHEN p_size > 20 THEN p_brand END, 'other') END AS place, CASE WHEN p_size BETWEEN 5 AND 40 THEN 'in range' END AS area, count(*) AS n FROM part GROUP BY ALL")
def place_classes(spark, d):
    name = F.col("p_name")
    place = F.when(name.contains("ring"), "rehab").when(name.contains("widget"), "madinaty").when(name.contains("small"), "mostakbal").otherwise(F.coalesce(F.when(F.col("p_size") > 20, F.col("p_brand")), F.lit("other")))
    return table(spark, d, "part").groupBy(place.alias("place"), F.when(F.col("p_size").between(5, 40), "in range").alias("area")).agg(F.count(F.lit(1)).alias("n"))


@query("crosstab_odds", f"""WITH {_BASE}, c AS (SELECT CAST(count(*) FILTER (flag = 'A' AND qty > 25) AS DOUBLE) AS a, CAST(count(*) FILTER (flag = 'A' AND qty <= 25) AS DOUBLE) AS b, CAST(count(*) FILTER (flag <> 'A' AND qty > 25) AS DOUBLE) AS c, CAST(count(*) FILTER (flag <> 'A' AND qty <= 25) AS DOUBLE) AS e FROM base)
  SELECT round((a + b + c + e) * pow(a * e - b * c, 2) / ((a + b) * (c + e) * (a + c) * (b + e)), 6) AS chi2, round(a * e / (b * c), 6) AS odds_ratio, round(exp(ln(a * e / (b * c)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / e)), 6) AS low, round(exp(ln(a * e / (b * c)) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / e)), 6) AS high FROM c""")
def crosstab_odds(spark, d):
    r = S.crosstab(base(spark, d), F.col("flag") == "A", F.col("qty") > 25)
    return spark.createDataFrame([tuple(round(r[k], 6) for k in ("chi2", "odds_ratio", "low", "high"))], "chi2 double, odds_ratio double, low double, high double")


@query("bootstrap_medians")
def bootstrap_medians(spark, d):
    return S.bootstrap_median(base(spark, d), "v", ["kind"])


@query("yield_bounds")
def yield_bounds(spark, d):
    b = base(spark, d)
    return S.ratio_bounds(b.where("flag = 'A'"), b.where("flag = 'N'"), "v", ["kind"])


@query("yield_difference")
def yield_difference(spark, d):
    b = base(spark, d)
    return S.yield_difference(b.where("flag = 'A'"), b.where("flag = 'N'"), "v", ["y"], "brand", "Brand#1", "Brand#11")


def _frame(spark, out: pd.DataFrame):
    return spark.createDataFrame(out.round(8))


@query("hedonic_ols", f"WITH {_BASE} SELECT 'intercept' AS term, round(regr_intercept(v, qty), 4) AS beta FROM base UNION ALL SELECT 'qty', round(regr_slope(v, qty), 4) FROM base")
def hedonic_ols(spark, d):
    return spark.createDataFrame(S.ols(base(spark, d), ["qty"], "v")[["term", "beta"]].round(4))


@query("hedonic_errors")
def hedonic_errors(spark, d):
    b = base(spark, d).withColumn("early", (F.col("y") < 1998).cast("double")).withColumn("both", F.col("early") * F.col("qty"))
    hc3, clustered = S.ols(b, ["qty", "disc", "early", "both"], "v"), S.ols(b, ["qty", "disc", "early", "both"], "v", cluster="brand")
    w, df = S.wald(hc3, ["early", "both"])
    value, low, high = S.combination(hc3, {"early": 1.0, "both": 20.0})
    more = pd.DataFrame({"term": ["wald", "premium"], "beta": [w, value], "se": [df, (high - low) / 3.92]})
    return _frame(spark, pd.concat([hc3.assign(kind="hc3"), clustered.assign(kind="cluster"), more.assign(kind="test")])[["kind", "term", "beta", "se"]])


@query("quantile_regression")
def quantile_regression(spark, d):
    return _frame(spark, S.median_regression(base(spark, d), ["qty", "disc"], "v"))


@query("boosted_trees")
def boosted_trees(spark, d):
    return _frame(spark, S.boosted(base(spark, d), ["qty", "disc"], "v"))
