"""Hedonic prices of one home in every place and period, and premiums of places; the SQL works the same regression out cell by cell."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hedonic as H
from ..operators import stats as S
from ..sources.views import table
from .registry import query

#: The home that is priced: its area, in the middle of those there are.
_AREA = 60
_FIT_SQL = f"""WITH h AS (SELECT l_returnflag AS place, quarter(l_shipdate) AS period, ln(l_extendedprice * 10) AS y, ln(l_quantity * 2) AS x FROM lineitem
    WHERE l_suppkey % 3 <> 1 AND l_extendedprice * 10 BETWEEN {S.SALE_BOUNDS[0]} AND {S.SALE_BOUNDS[1]} AND l_quantity * 2 BETWEEN {S.AREA_BOUNDS[0]} AND {S.AREA_BOUNDS[1]}),
  c AS (SELECT place, period, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM h GROUP BY ALL),
  t AS (SELECT place, period, n, x - mx AS tx, y - my AS ty FROM h JOIN c USING (place, period)),
  s AS (SELECT sum(tx * tx) AS sxx, sum(tx * ty) / sum(tx * tx) AS b FROM t),
  w AS (SELECT place, period, tx, pow((ty - b * tx) / (1 - 1.0 / n - tx * tx / sxx), 2) AS w FROM t, s),
  g AS (SELECT c.*, sum(w) AS w0, sum(w * tx) AS w1 FROM w JOIN c USING (place, period) GROUP BY ALL),
  a AS (SELECT sxx, b, sum(w * tx * tx) AS w2 FROM w, s GROUP BY ALL)"""


def _model(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.lit("SALE").alias("listing_type"), F.get(F.array(F.lit("APARTMENT"), F.lit("LAND"), F.lit("VILLA")), (F.col("l_suppkey") % 3).cast("int")).alias("property_type"),
        (F.col("l_extendedprice") * 10).alias("price"), (F.col("l_quantity") * 2).alias("area_sqm"), F.col("l_returnflag").alias("place"), F.quarter("l_shipdate").alias("period"),
    )
    rows = S.plausible(rows).select("place", "period", F.log("price").alias("log_price"), F.log("area_sqm").alias("log_area"))
    design = H.Design.of(rows, ["log_area"], {"place": "A", "period": 1}, [("place", "period")])
    places, periods = (spark.createDataFrame([(v,) for v in vs], f"{n} {t}") for n, t, vs in (("place", "string", "ANR"), ("period", "int", (1, 2, 3, 4))))
    grid = places.join(F.broadcast(periods), F.lit(True)).withColumn("log_area", F.log(F.lit(float(_AREA))))  # 3 x 4 rows
    return design, design.fit(rows, "log_price"), grid


@query("predicted_prices", f"""{_FIT_SQL}, v AS (SELECT place, period, my + b * (ln({_AREA}) - mx) AS v, ln({_AREA}) - mx AS d, * EXCLUDE (place, period) FROM g, a),
  e AS (SELECT place, period, v, 1.959963984540054 * sqrt(w0 / (n * n) + 2 * d * w1 / (n * sxx) + d * d * w2 / (sxx * sxx)) AS half FROM v)
  SELECT place, period, round(exp(v), 1) AS price, round(exp(v - half), 1) AS low, round(exp(v + half), 1) AS high FROM e""")
def predicted_prices(spark, d):
    """The price of one home in every place and period by the regression with robust errors."""
    design, fit, grid = _model(spark, d)
    return H.predictions(grid, design, fit).select("place", "period", F.round("value", 1).alias("price"), F.round("low", 1).alias("low"), F.round("high", 1).alias("high"))


@query("place_premiums", f"""{_FIT_SQL}, v AS (SELECT g.place, g.period, g.my - r.my - b * (g.mx - r.mx) AS v, r.mx - g.mx AS d, g.n, r.n AS rn, g.w0, r.w0 AS rw0, g.w1, r.w1 AS rw1, sxx, w2 FROM g JOIN g r ON r.place = 'A' AND r.period = g.period, a WHERE g.place <> 'A'),
  e AS (SELECT place, period, v, 1.959963984540054 * sqrt(w0 / (n * n) + rw0 / (rn * rn) + 2 * d / sxx * (w1 / n - rw1 / rn) + d * d * w2 / (sxx * sxx)) AS half FROM v)
  SELECT place, period, round(exp(v) - 1, 6) AS premium, round(exp(v - half) - 1, 6) AS low, round(exp(v + half) - 1, 6) AS high FROM e""")
def place_premiums(spark, d):
    """What places cost above place A in the same period."""
    design, fit, grid = _model(spark, d)
    return H.premiums(grid.where("place <> 'A'"), design, fit, "place", "A").select("place", "period", F.round("premium", 6).alias("premium"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
