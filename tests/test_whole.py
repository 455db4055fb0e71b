"""Queries over whole tables, and operators where a cut would show."""
import math

import pytest
from pyspark.sql import functions as F

from adlens.operators import stats as S
from adlens.plans import registry

SF = "/root/testdata/sf0.001"


def test_holm_has_no_single_task_window(spark, capfd):
    p = [((i * 7919) % 997 % 250) / 4e5 for i in range(1500)] + [None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id long, p double")
    out = S.holm(rows, "p", ["id"])
    got = {r.id: r.p_holm for r in out.collect()}
    want, high = {}, 0.0
    for k, (x, i) in enumerate(sorted((x, i) for i, x in enumerate(p) if x is not None)):
        want[i] = high = max(high, min(1.0, x * (1500 - k)))
    assert got == want
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert S.holm(rows.where("false"), "p", ["id"]).count() == 0


def test_whole_tables(spark):
    q = registry.QUERIES
    assert q["holm_correction_all"](spark, SF).count() == spark.read.parquet(f"{SF}/part.parquet").count()
    keys = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert q["period_steps_all"](spark, SF).select("k").distinct().count() == keys


def test_documents_mixed_judges_every_document(spark):
    status = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("document_id"), "o_orderstatus")
    found = registry.QUERIES["documents_mixed_all"](spark, SF).join(status, "document_id")
    assert {r[0] for r in found.select("o_orderstatus").distinct().collect()} == {"F", "O", "P"}


def test_bootstrap_is_exact_in_large_groups(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    groups = {"a": rng.integers(0, 10**6, 20001) / 8, "b": rng.integers(0, 10**6, 9000) / 8, "c": np.array([3.0, 5.0]), "d": np.array([4.0]), None: np.array([1.0, 1.0, 9.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "g string, v double")
    out = {r.g: r for r in S.median_draws(rows, "v", ["g"]).collect()}
    assert {k: (r.n, r.median, len(r.draws)) for k, r in out.items()} == {k: (len(v), float(np.median(v)), 2000) for k, v in groups.items()}
    for k, v in groups.items():
        sample = np.median(v[rng.integers(0, len(v), (1000, len(v)))], axis=1) if len(v) < 100 else None
        if sample is not None:
            assert abs(np.mean(out[k].draws) - sample.mean()) < 0.5
    a = np.array(out["a"].draws)
    assert np.isin(a, groups["a"]).all()
    # The median of n uniform values on a width of 125,000 has an error of width / (2 * sqrt(n)).
    assert abs(a.std() / (125_000 / (2 * np.sqrt(20001))) - 1) < 0.15
    bounds = {r.g: r for r in S.bootstrap_median(rows, "v", ["g"]).collect()}
    assert np.allclose([bounds["b"].low, bounds["b"].high], np.quantile(out["b"].draws, [0.025, 0.975]))


def test_ratio_and_difference_draw_both_sides(spark):
    rows = spark.createDataFrame([(y, g, float(i * i % 101 + 100 + 60 * (g == "t"))) for y in (1, 2) for g in "st" for i in range(301)], "y int, g string, v double")
    same = S.ratio_draws(rows, rows, "v", ["y", "g"]).collect()
    assert len(same) == 4 and all(r.ratio == 1 and len(set(r.draws)) > 1 for r in same)
    far = rows.withColumn("v", F.when(F.col("g") == "t", F.col("v") * 2).otherwise(F.col("v")))
    for r in S.yield_difference(far, rows, "v", ["y"], "g", "t", "s").collect():
        assert r.low > 0 and r.p == 0 and r.low <= r.difference <= r.high
    for r in S.yield_difference(rows, rows, "v", ["y"], "g", "t", "s").collect():
        assert r.low < 0 < r.high and r.p > 0.05


def test_paired_t():
    t, p = S.paired_t([0.9, 0.8, 0.85, 0.95, 0.7], [0.8, 0.75, 0.8, 0.8, 0.72])
    assert abs(t - 0.066 / (0.00403 / 5) ** 0.5) < 1e-9 and 0.05 < p < 0.1  # 2.776 and 2.132 are the bounds of 4 degrees of freedom
    for df, bound in ((1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (7, 2.365), (10, 2.228)):
        assert abs(S.student_p(bound, df) - 0.05) < 1e-4
    assert S.student_p(0.0, 5) == 1.0


def test_shuffled_is_a_permutation(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), i) for i in range(3000)], "a double, b double, id long")
    out = S.shuffled(rows, "a", ["a", "b", "id"], 3)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id, r.a) for r in out.collect())
    assert [i for i, _ in got] == list(range(3000)) and sorted(a for _, a in got) == [float(i) for i in range(3000)]
    assert sum(i == a for i, a in got) < 30


def test_boosted_looks_at_all_years(spark, monkeypatch):
    from adlens.plans import q_stats

    seen = {}
    monkeypatch.setattr(S, "boosted", lambda rows, x, y, **options: seen.update(n=rows.count(), options=options) or S.pd.DataFrame({"fold": [0]}))
    q_stats.boosted_trees(spark, SF)
    assert seen == {"n": spark.read.parquet(f"{SF}/lineitem.parquet").count(), "options": {}}


def test_boosted_tests_the_last_feature(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i * 7 % 11), float(i % 10 + 3 * (i * 7 % 11)) + i % 3 * 0.1) for i in range(600)], "a double, b double, v double")
    out = S.boosted(rows, ["a", "b"], "v", folds=3, iterations=2)
    assert len(out) == 3 and (out.r2 > out.r2_less).all() and (out.importance_b > 0).all()
    assert out.t.iloc[0] > 0 and 0 <= out.p.iloc[0] < 0.05


def test_boosted_fits_cells(spark, monkeypatch):
    """Trees see one weighted row for each combination of features, whose scores are those of all rows."""
    import pyspark.ml.regression as ml

    fit, seen = ml.GBTRegressor.fit, []
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda self, data, *more: seen.append(data.count()) or fit(self, data, *more))
    rows = spark.createDataFrame([(float(i % 10), float(i * 7 % 11), float(i % 10 + 3 * (i * 7 % 11)) + i % 3 * 0.1) for i in range(3300)], "a double, b double, v double")
    out = S.boosted(rows, ["a", "b"], "v", folds=2, iterations=3)
    assert min(seen) == 10 and max(seen) <= 110 and out.r2.between(0.8, 1).all()


def test_dealt_stays_in_its_group(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") * 10 + F.col("id") % 3).alias("v"))
    got = S.dealt(rows, ["v"], ["id", "v"], 3, "g", 3).collect()
    assert len(got) == 3000 and all(r._s_v % 10 == r.g for r in got) and {r._s_v for r in got} == {r.v for r in got} and sum(r.v == r._s_v for r in got) < 30


def test_p_values(spark):
    """Upper five per cent of chi squared with 1 to 5 degrees, and of the normal distribution."""
    x = [(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (11.070498, 5)]
    rows = spark.createDataFrame(x, "x double, k int").select(F.round(S.chi2_p(F.col("x"), F.col("k")), 5).alias("p")).collect()
    assert [r.p for r in rows] == [0.05] * 5
    z = spark.createDataFrame([(1.959964,), (-1.959964,), (0.0,), (None,)], "z double").select(F.round(S.normal_p(F.col("z")), 5).alias("p")).collect()
    assert [r.p for r in z] == [0.05, 0.05, 1.0, None]


def test_ols_has_p_values(spark):
    rows = spark.createDataFrame([(float(i % 7), float(2 * (i % 7) + (i * 37 % 11) / 10)) for i in range(60)], "x double, y double")
    fit = S.ols(rows, ["x"], "y")
    z = fit.z.to_numpy()
    assert fit.p.tolist() == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in z]) and fit.p[1] < 1e-6
