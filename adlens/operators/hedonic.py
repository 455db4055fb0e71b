"""Hedonic models with categories: design columns, and what a fit says of a grid with bounds (predictions, premiums)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import normal_p, ols

#: Fixed value: the 0.975 quantile of the standard normal distribution.
NORMAL_95 = 1.959963984540054


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@dataclass(frozen=True)
class Design:
    """Numeric columns, 0/1 columns of each factor's levels but its reference, and of the pairs of levels of crossed factors that rows have.

    ``terms`` are (label, {factor: level}); a numeric column's term has its name and no levels.
    """

    numeric: tuple[str, ...]
    terms: tuple[tuple[str, tuple[tuple[str, Any], ...]], ...]
    seen: Mapping[tuple[str, str], frozenset]

    @classmethod
    def of(cls, rows: DataFrame, numeric: Sequence[str], factors: Mapping[str, Any], crossed: Sequence[tuple[str, str]] = (), *, most: int = 64) -> Design:
        """``factors`` gives each factor's reference level. More than ``most`` levels of a factor, or pairs, are an error: the normal equations grow with their square."""

        def values(*names: str) -> list[tuple]:
            found = sorted(tuple(r) for r in rows.select(*names).na.drop().distinct().limit(most + 1).collect())
            if len(found) > most:
                raise ValueError(f"{' x '.join(names)}: more than {most} levels")
            return found

        terms = [(n, ()) for n in numeric]
        for factor, reference in factors.items():
            levels = [v for (v,) in values(factor)]
            if reference not in levels:
                raise ValueError(f"{factor} has no row of its reference {reference!r}")
            terms += [(f"{factor}[{v}]", ((factor, v),)) for v in levels if v != reference]
        seen = {}
        for a, b in crossed:
            pairs = values(a, b)
            seen[a, b] = frozenset(pairs)
            terms += [(f"{a}[{u}]:{b}[{v}]", ((a, u), (b, v))) for u, v in pairs if u != factors[a] and v != factors[b]]
        return cls(tuple(numeric), tuple(terms), seen)

    @property
    def labels(self) -> list[str]:
        return [label for label, _ in self.terms]

    def columns(self, other: Mapping[str, Column] | None = None) -> list[Column]:
        """The terms' values as doubles; ``other`` stands in for columns of its names."""
        other = other or {}
        out = []
        for label, levels in self.terms:
            if not levels:
                out.append(other.get(label, F.col(label)).cast("double"))
                continue
            hit = F.lit(True)
            for factor, level in levels:
                hit = hit & (other.get(factor, F.col(factor)) == F.lit(level))
            out.append(hit.cast("double"))
        return out

    def vector(self, other: Mapping[str, Column] | None = None) -> Column:
        """1 for the intercept and the terms' values; null where a value is missing, or rows have no such pair of levels."""
        other = other or {}
        columns = self.columns(other)
        known = F.lit(True)
        for c in columns:
            known = known & c.isNotNull()
        for (a, b), pairs in self.seen.items():
            pair = F.lit(False)
            for u, v in sorted(pairs):
                pair = pair | ((other.get(a, F.col(a)) == F.lit(u)) & (other.get(b, F.col(b)) == F.lit(v)))
            known = known & pair
        return F.when(known, F.array(F.lit(1.0), *columns))

    def fit(self, rows: DataFrame, y: str, *, cluster: str | None = None) -> pd.DataFrame:
        """``stats.ols`` on these columns; rows with a null are left out."""
        names = [f"_x{i}" for i in range(len(self.terms))]
        keep = [F.col(y), *([F.col(cluster)] if cluster else [])]
        out = ols(rows.select(*keep, *(c.alias(n) for c, n in zip(self.columns(), names, strict=True))), names, y, cluster=cluster)
        out["term"] = ["intercept", *self.labels]
        return out


def _estimates(rows: DataFrame, vector: Column, fit: pd.DataFrame) -> DataFrame:
    """``value`` and ``se`` of each row's linear combination: x b, and the root of x V x."""
    covariance: np.ndarray = fit.attrs["cov"]
    x = F.col("_x")
    spread = F.transform(F.array(*(_numbers(r) for r in covariance)), lambda r: _dot(r, x))
    held = rows.withColumn("_x", vector)
    return held.withColumns({"value": _dot(x, _numbers(fit["beta"])), "se": F.sqrt(F.greatest(F.lit(0.0), _dot(x, spread)))}).drop("_x")


def predictions(grid: DataFrame, design: Design, fit: pd.DataFrame, *, log: bool = True) -> DataFrame:
    """The grid with ``value``, ``low`` and ``high``: the predicted mean and its 95 % bounds, back from the logarithm if ``log``.

    The grid has the design's numeric columns and factors. A cell that no row has isn't priced: null.
    """
    back = F.exp if log else (lambda c: c)
    out = _estimates(grid, design.vector(), fit)
    half = NORMAL_95 * F.col("se")
    return out.withColumns({"low": back(F.col("value") - half), "high": back(F.col("value") + half), "value": back(F.col("value"))}).drop("se")


def premiums(grid: DataFrame, design: Design, fit: pd.DataFrame, factor: str, reference: Any, *, log: bool = True) -> DataFrame:
    """The grid with ``premium``, ``low``, ``high`` and ``p``: each row against the same row at the factor's ``reference``, as a share if ``log``."""
    back = F.expm1 if log else (lambda c: c)
    there, here = design.vector(), design.vector({factor: F.lit(reference)})
    out = _estimates(grid, F.zip_with(there, here, lambda a, b: a - b), fit)
    half = NORMAL_95 * F.col("se")
    p = normal_p(F.try_divide(F.col("value"), F.col("se")))
    return out.withColumns({"premium": back(F.col("value")), "low": back(F.col("value") - half), "high": back(F.col("value") + half), "p": p}).drop("value", "se")
