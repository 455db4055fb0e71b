"""Exact quantiles and ranks against numpy; cursors, snapshots, labels and the stream fold's guard."""
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.functions import scalars
from adlens.operators import cursors, merge, quantiles

QS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def groups():
    rng = np.random.default_rng(3)
    return {
        "one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 50, "zero": [0.0, 0.0, -1.0, 1.0], None: [3.0, 1.0, 2.0],
        "mixed": [*rng.normal(0, 1e6, 400), *([12.25] * 100)], "near": list(np.round(1000 + rng.random(500), 2)), "wide": [float(x) for x in 10.0 ** rng.uniform(-200, 200, 300)],
    }


def table(spark, found):
    rows = [(k, float(v)) for k, vs in found.items() for v in vs] + [("one", None), ("empty", None)]
    return spark.createDataFrame(rows, "k string, v double")


def test_quantiles_are_exact(spark):
    found = groups()
    got = {r.k: (r.n, r.q) for r in quantiles.exact_quantiles(table(spark, found), "v", ["k"], QS).collect()}
    assert set(got) == set(found)
    for k, vs in found.items():
        assert got[k][0] == len(vs)
        np.testing.assert_allclose(got[k][1], np.quantile(vs, QS), rtol=1e-12)


def test_quantiles_without_keys(spark):
    values = groups()["mixed"]
    row = quantiles.exact_quantiles(table(spark, {"mixed": values}), "v", [], (0.5,)).first()
    assert row.n == len(values) and row.q[0] == pytest.approx(np.median(values), rel=1e-12)


def test_quantiles_of_an_empty_table(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "k string, v double"), "v", ["k"], (0.5,)).count() == 0


def test_bands_never_fall(spark):
    values = sorted(v for vs in groups().values() for v in vs) + [float("inf")]
    got = [r.b for r in spark.createDataFrame([(float(v),) for v in [float("-inf"), *values]], "v double").select("v", quantiles.band(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


def test_ranks_share_their_mean(spark):
    found = {k: vs for k, vs in groups().items() if k is not None}
    got = quantiles.average_ranks(table(spark, found), "v", ["k"]).collect()
    for k, vs in found.items():
        ranks = {v: np.mean([i + 1 for i, x in enumerate(sorted(vs)) if x == v]) for v in vs}
        assert sorted((r.v, r.rank, r.ties) for r in got if r.k == k) == sorted((v, ranks[v], vs.count(v)) for v in vs)


def test_cursors(spark):
    saved = spark.createDataFrame([("s", "a", "k1", False), ("s", "b", None, False), ("s", "old b", "k2", False), ("s", "old c", None, True), ("t", "old d", "k3", True)], "source_key string, scope string, resume_key string, done boolean")
    wanted = spark.createDataFrame([("s", x, f"old {x}") for x in "abcd"], "source_key string, scope string, legacy string")
    found = cursors.adopt(saved, wanted)
    got = {r.scope: (r.resume_key, r.done, r.adopted) for r in found.collect()}
    assert got == {"a": ("k1", False, False), "b": ("k2", False, True), "c": (None, True, True), "d": (None, False, False)}
    after = {(r.source_key, r.scope): (r.resume_key, r.done) for r in cursors.save(saved, found.where("adopted")).collect()}
    assert len(after) == 6 and after["s", "b"] == ("k2", False) and after["s", "c"] == (None, True)


def test_snapshot(spark):
    rows = spark.createDataFrame(
        [(1, "x", Decimal("5.50"), None, {"_raw": '{"p": "5.5"}', "_extraction": '{"graph_version": 3, "template": "page"}'}), (2, None, None, "2024-01-02 03:04:05.5", None)],
        "id int, title string, price decimal(9,2), listed_at string, attributes map<string,string>",
    ).withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))
    a, b = merge.snapshot(rows).orderBy("id").collect()
    assert json.loads(a.snapshot) == {"title": "x", "price": "5.50", "listed_at": None, "raw": {"p": "5.5"}}
    assert (a.graph_version, a.template_key, b.graph_version, b.template_key) == (3, "page", None, None)
    assert json.loads(b.snapshot) == {"title": None, "price": None, "listed_at": "2024-01-02T03:04:05.500000", "raw": {}}


@pytest.mark.parametrize(("label", "want"), [
    ("Zed, Giza", ("Zed", "Giza", "Zed", None)), ("Giza, Giza", ("Giza", "Giza", None, None)), (" Zed ,, Maadi ", ("Zed", "Cairo", "Maadi", None)),
    ("Zed, Nowhere", ("Zed", None, "Nowhere", "Nowhere")), ("Giza", ("Giza", "Giza", None, None)), ("Nowhere", ("Nowhere", None, None, "Nowhere")),
    ("Land", ("Land", None, None, None)), ("", ("Land", None, None, None)), (None, ("Land", None, None, None)), (" , ", ("Land", None, None, None)),
])
def test_labels(spark, label, want):
    row = spark.createDataFrame([(label,)], "l string").select(scalars.place_of_label(F.col("l"), ["Giza", "Cairo"], {"Maadi": "Cairo"}, "Land").alias("p")).first().p
    assert tuple(row) == want


def test_fold_refuses_a_history_that_its_checkpoint_does_not_know(spark, tmp_path):
    from adlens.streaming.ingest import fold

    (tmp_path / "out" / "history-0").mkdir(parents=True)
    with pytest.raises(ValueError, match="history"):
        fold(spark, None, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
