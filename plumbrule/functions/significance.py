"""Tail probabilities of the test statistics.  Inputs are one row per tested column."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def kolmogorov_sf(statistic: Column, n_ref: Column, n_new: Column) -> Column:
    """Two-sided Kolmogorov-Smirnov p-value from the limiting series."""
    lam2 = statistic * statistic * (n_ref * n_new / (n_ref + n_new))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam2),
    )
    # the series is useless (and the answer is 1) for very small arguments
    return F.when(lam2 < 0.02, F.lit(1.0)).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, front * h)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1) < 1e-15:
            break
    return h


def _regular_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _chi2_batch(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) or pd.isna(k) else 1.0 if k == 0 else _upper_gamma(k / 2, x / 2) for x, k in zip(statistic, dof)],
        dtype="float64",
    )


def _f_batch(statistic: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(f) or pd.isna(a) or pd.isna(b) else _regular_beta(b / 2, a / 2, b / (b + a * f))
            for f, a, b in zip(statistic, d1, d2)
        ],
        dtype="float64",
    )


def chi2_sf(statistic: str, dof: str) -> Column:
    """P(chi-squared with ``dof`` degrees of freedom > statistic)."""
    return F.pandas_udf(_chi2_batch, "double")(statistic, dof)


def f_sf(statistic: str, d1: Column, d2: Column) -> Column:
    """P(F(d1, d2) > statistic)."""
    return F.pandas_udf(_f_batch, "double")(statistic, d1, d2)
