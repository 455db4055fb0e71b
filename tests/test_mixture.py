"""Mixture flags from counted values: the fit settles, whatever the layout of the rows, and each row keeps its flag."""
import numpy as np
from pyspark.sql import functions as F

from adlens.operators import stats as S


def sample(spark, parts):
    rng = np.random.default_rng(4)
    logs = np.concatenate([rng.normal(-3, 0.3, 400), rng.normal(0, 0.2, 1600)])
    rows = [(i, "k" if i % 3 else None, float(np.exp(x))) for i, x in enumerate(logs)] + [(-1, "few", 1.0), (-2, "k", None), (-3, "k", -1.0)]
    return spark.createDataFrame(rows, "id long, kind string, v double").repartition(parts, "id")


def flags(spark, parts, **options):
    out = S.flag_mixture(sample(spark, parts), "v", ["kind"], **options)
    return {r.id: r.low for r in out.collect()}


def test_flags_do_not_follow_the_layout(spark):
    one, many = flags(spark, 1), flags(spark, 7)
    assert one == many and len(one) == 2003
    first = flags(spark, 3, passes=1)
    assert sum(first[i] for i in range(400)) >= 398 and not any(first[i] for i in range(400, 2000)) and not any(first[i] for i in (-1, -2, -3))


def test_fit_settles_on_counts_as_on_rows(spark):
    x = sample(spark, 3).where("v > 0").select(F.log("v").alias("x"))
    weighed = x.select(F.round("x", 1).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    single = x.select(F.round("x", 1).alias("x"), F.lit(1).alias("n"))
    a, b = S.two_normals(weighed, "x", "n"), S.two_normals(single, "x", "n")
    assert np.allclose(a, b, atol=1e-6) and np.allclose([m for m, _, _ in a], [-3, 0], atol=0.05) and abs(a[0][2] - 0.2) < 0.01


def test_fit_without_rows(spark):
    assert S.two_normals(spark.createDataFrame([], "x double, n long"), "x", "n") == []
