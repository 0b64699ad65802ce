"""Least-squares families fitted from one pass of sums of products.

All data-dependent work is :func:`plumbrule.core.moments.moments`; what follows runs on (d x d) numbers,
so a whole regularisation path or a gradient-descent history costs no further pass over the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.core.moments import Moments, moments
from plumbrule.functions.columns import dot


@dataclass
class LinearFit:
    names: list[str]
    weights: np.ndarray
    intercept: float
    history: list[float] = field(default_factory=list)
    path: list[np.ndarray] = field(default_factory=list)

    def column(self) -> Column:
        return dot(self.names, self.weights, self.intercept)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.column())

    def table(self, spark) -> DataFrame:
        rows = [("(intercept)", float(self.intercept)), *[(n, float(w)) for n, w in zip(self.names, self.weights)]]
        return spark.createDataFrame(rows, "term string, coefficient double")


def xy_moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    return moments(df, [*features, target])


def _centred(m: Moments, features: Sequence[str], target: str):
    at, j = [m.names.index(c) for c in features], m.names.index(target)
    return m.scatter[np.ix_(at, at)], m.scatter[at, j], m.scatter[j, j], m.mean[at], m.mean[j]


def _with_ones(m: Moments, features: Sequence[str], target: str, intercept: bool = True):
    """Raw normal-equation matrix, right-hand side and sum of squares, with a leading constant."""
    raw = m.raw()
    at, j = [m.names.index(c) for c in features], m.names.index(target)
    a, b, yy = raw[np.ix_(at, at)], raw[at, j], raw[j, j]
    if intercept:
        s = m.n * m.mean[at]
        a = np.block([[np.array([[m.n]]), s[None, :]], [s[:, None], a]])
        b = np.r_[m.n * m.mean[j], b]
    return a, b, yy


def _unpack(features: Sequence[str], w: np.ndarray, intercept: bool, history=()) -> LinearFit:
    return LinearFit(list(features), w[1:] if intercept else w, float(w[0]) if intercept else 0.0, list(history))


def least_squares(m: Moments, features: Sequence[str], target: str) -> LinearFit:
    a, b, _, mx, my = _centred(m, features, target)
    w = np.linalg.solve(a, b) if np.linalg.cond(a) < 1e12 else np.linalg.lstsq(a, b, rcond=None)[0]
    return LinearFit(list(features), w, float(my - mx @ w))


def gradient_descent(m: Moments, features: Sequence[str], target: str, rate: float = 0.01, steps: int = 1000, intercept: bool = True) -> LinearFit:
    """Batch descent on the mean squared error from zero weights, with the loss before every step."""
    a, b, yy = _with_ones(m, features, target, intercept)
    w, history = np.zeros(len(b)), []
    for _ in range(steps):
        history.append(float((yy - 2 * b @ w + w @ a @ w) / m.n))
        w = w - rate * (2.0 / m.n) * (a @ w - b)
    return _unpack(features, w, intercept, history)


def adaline(m: Moments, features: Sequence[str], target: str, rate: float = 0.01, steps: int = 50, intercept: bool = True) -> LinearFit:
    """Linear unit trained on 0/1 targets; predict class 1 from an output of 0.5 on."""
    half = gradient_descent(m, features, target, rate / 2.0, steps, intercept)
    return half


def adaline_class(fit: LinearFit) -> Column:
    return (fit.column() >= 0.5).cast("int")


def ridge(m: Moments, features: Sequence[str], target: str, alpha: float = 1.0) -> LinearFit:
    a, b, _, mx, my = _centred(m, features, target)
    w = np.linalg.pinv(a + alpha * np.eye(len(b))) @ b
    return LinearFit(list(features), w, float(my - mx @ w))


def elastic_net(m: Moments, features: Sequence[str], target: str, alpha: float = 1.0, l1_ratio: float = 0.5, steps: int = 1000, tol: float = 1e-4) -> LinearFit:
    """Coordinate descent on the covariance form; penalties grow with the row count."""
    if not 0.0 <= l1_ratio <= 1.0:
        raise ValueError("l1_ratio must lie between 0 and 1")
    a, b, _, mx, my = _centred(m, features, target)
    w, path = np.zeros(len(b)), []
    l1, l2 = alpha * l1_ratio * m.n, alpha * (1 - l1_ratio) * m.n
    for _ in range(steps):
        before = w.copy()
        for j in range(len(b)):
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0.0) / (a[j, j] + l2 + 1e-12)
        path.append(w.copy())
        if np.max(np.abs(w - before)) < tol:
            break
    return LinearFit(list(features), w, float(my - mx @ w), path=path)


def lasso(m: Moments, features: Sequence[str], target: str, alpha: float = 1.0, **kw) -> LinearFit:
    return elastic_net(m, features, target, alpha, 1.0, **kw)


def regularization_path(spark, m: Moments, features: Sequence[str], target: str, alphas: Sequence[float], kind: str = "lasso") -> DataFrame:
    """Long table of coefficients and their non-zero count for every penalty; no pass over the data."""
    rows = []
    for alpha in alphas:
        fit = ridge(m, features, target, alpha) if kind == "ridge" else lasso(m, features, target, alpha)
        alive = int(np.sum(np.abs(fit.weights) > 1e-10))
        rows += [(float(alpha), n, float(w), alive) for n, w in zip(features, fit.weights)]
    return spark.createDataFrame(rows, "alpha double, feature string, coefficient double, nonzero int")


@dataclass
class BayesianFit:
    names: list[str]
    mean: np.ndarray
    cov: np.ndarray
    beta: float

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``variance`` (noise plus parameter uncertainty)."""
        x = [F.lit(1.0), *[F.col(quoted(n)).cast("double") for n in self.names]]
        spread = F.lit(1.0 / self.beta)
        for i in range(len(x)):
            for j in range(i, len(x)):
                spread = spread + x[i] * x[j] * float(self.cov[i, j] * (1 if i == j else 2))
        return df.withColumns({"prediction": dot(self.names, self.mean[1:], self.mean[0]), "variance": spread})


def bayesian_regression(m: Moments, features: Sequence[str], target: str, alpha: float = 1.0, beta: float = 1.0) -> BayesianFit:
    a, b, _ = _with_ones(m, features, target)
    cov = np.linalg.pinv(alpha * np.eye(len(b)) + beta * a)
    return BayesianFit(list(features), beta * cov @ b, cov, beta)


def perceptron(df: DataFrame, features: Sequence[str], target: str, rate: float = 0.01, epochs: int = 10) -> LinearFit:
    """Perceptron by parameter mixing: every task makes one sequential pass from the shared weights, and the
    weights of the tasks are averaged by row count before the next epoch.  ``history`` holds update counts."""
    names = [quoted(f) for f in features]
    base = df.select(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)], F.col(quoted(target)).cast("double").alias("y")).dropna("any")
    d = len(features) + 1
    w, history = np.zeros(d), []
    for _ in range(epochs):
        start = w.copy()

        def epoch(batches, start=start):
            v, wrong, n = start.copy(), 0, 0
            for batch in batches:
                data = batch.to_numpy(dtype=float)
                for row in data:
                    x = np.r_[1.0, row[:-1]]
                    step = rate * (row[-1] - (1.0 if x @ v >= 0.0 else 0.0))
                    if step:
                        v += step * x
                        wrong += 1
                n += len(data)
            yield pd.DataFrame({"n": [n], "wrong": [wrong], "w": [v.tolist()]})

        parts = base.mapInPandas(epoch, "n long, wrong long, w array<double>")
        row = parts.agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), *[F.sum(F.col("n") * F.col("w")[i]).alias(f"w{i}") for i in range(d)]).first()
        if not row["n"]:
            break
        w = np.array([row[f"w{i}"] for i in range(d)]) / row["n"]
        history.append(float(row["wrong"]))
        if row["wrong"] == 0:
            break
    return LinearFit(list(features), w[1:], float(w[0]), history)


def perceptron_class(fit: LinearFit) -> Column:
    return (fit.column() >= 0.0).cast("int")
