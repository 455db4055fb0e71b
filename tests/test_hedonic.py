"""Hedonic grids against the same algebra in numpy."""
from math import erfc, sqrt

import numpy as np
import pytest

from adlens.operators import hedonic as H


def test_predictions_and_premiums(spark):
    draw = np.random.default_rng(5)
    rows = [(p, h, float(a), float(1 + 0.9 * a + 0.3 * (p == "B") + 0.2 * h + 0.1 * (p == "B") * h + 0.05 * draw.standard_normal())) for p in "AB" for h in (0, 1, 2) for a in draw.normal(4, 0.4, 30) if (p, h) != ("B", 2)]
    df = spark.createDataFrame([*rows, ("A", 0, None, 3.0), (None, 1, 4.0, 3.0)], "place string, half int, area double, y double")
    design = H.Design.of(df, ["area"], {"place": "A", "half": 0}, [("place", "half")])
    assert design.labels == ["area", "place[B]", "half[1]", "half[2]", "place[B]:half[1]"]
    fit = design.fit(df, "y")
    vector = lambda p, h, a: np.array([1, a, p == "B", h == 1, h == 2, p == "B" and h == 1], float)
    x, y = np.array([vector(*r[:3]) for r in rows]), np.array([r[3] for r in rows])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    w = ((y - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inv, x))) ** 2
    cov = inv @ (x.T * w) @ x @ inv
    grid = spark.createDataFrame([("A", 0, 4.0), ("B", 1, 4.5), ("B", 2, 4.0), ("B", 0, None), ("C", 0, 4.0)], "place string, half int, area double")
    got = {(r.place, r.half): r for r in H.predictions(grid, design, fit, log=False).collect()}
    for key, a in ((("A", 0), 4.0), (("B", 1), 4.5)):
        v = vector(*key, a)
        se = sqrt(v @ cov @ v)
        assert [got[key].value, got[key].low, got[key].high] == pytest.approx([v @ beta, v @ beta - H.NORMAL_95 * se, v @ beta + H.NORMAL_95 * se], rel=1e-8)
    assert all(got[k].value is None and got[k].low is None for k in (("B", 2), ("B", 0), ("C", 0)))  # no such cell, no area, no such level
    r = {(r.place, r.half): r for r in H.premiums(grid, design, fit, "place", "A").collect()}["B", 1]
    v = vector("B", 1, 4.5) - vector("A", 1, 4.5)
    assert [r.premium, r.low] == pytest.approx([np.expm1(v @ beta), np.expm1(v @ beta - H.NORMAL_95 * sqrt(v @ cov @ v))], rel=1e-8)
    assert r.p == pytest.approx(erfc(abs(v @ beta) / sqrt(v @ cov @ v) / sqrt(2)), abs=3e-7)
    with pytest.raises(ValueError):
        H.Design.of(df, ["area"], {"place": "Z"})
    with pytest.raises(ValueError):
        H.Design.of(df, ["area"], {"half": 0}, most=2)
