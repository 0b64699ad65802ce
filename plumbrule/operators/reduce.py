"""Projections fitted from moments, and reconstruction errors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.core.moments import grouped_moments, moments


@dataclass
class Projection:
    """Centre, columns of the projection and the variance each keeps."""

    names: list[str]
    mean: np.ndarray
    axes: np.ndarray  # features x components
    variance: np.ndarray
    ratio: np.ndarray

    def columns(self) -> list[Column]:
        out = []
        for k in range(self.axes.shape[1]):
            c = F.lit(0.0)
            for name, m, a in zip(self.names, self.mean, self.axes[:, k]):
                c = c + (F.col(quoted(name)).cast("double") - float(m)) * float(a)
            out.append(c)
        return out

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        return df.withColumns({f"{prefix}{k + 1}": c for k, c in enumerate(self.columns())})

    def scree(self, spark) -> DataFrame:
        rows = [(i + 1, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(self.variance, self.ratio, np.cumsum(self.ratio)))]
        return spark.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")

    def loadings(self, spark) -> DataFrame:
        rows = [(n, k + 1, float(self.axes[i, k])) for i, n in enumerate(self.names) for k in range(self.axes.shape[1])]
        return spark.createDataFrame(rows, "feature string, component int, loading double")


def pca(df: DataFrame, features: Sequence[str], components: int | None = None, whiten: bool = False) -> Projection:
    """Principal axes of the sample covariance; each axis points where its largest loading is positive."""
    m = moments(df, features)
    values, vectors = np.linalg.eigh(m.covariance(1))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    vectors = vectors * np.where(flip == 0, 1.0, flip)
    k = components or len(features)
    axes = vectors[:, :k] / (np.sqrt(np.maximum(values[:k], 1e-12)) if whiten else 1.0)
    return Projection(list(features), m.mean, axes, values[:k], values[:k] / max(values.sum(), 1e-300))


def lda(df: DataFrame, features: Sequence[str], label: str, components: int = 2) -> Projection:
    """Discriminant axes from per-class moments; at most classes - 1 of them."""
    groups = grouped_moments(df, features, label)
    n = sum(g.n for g in groups.values())
    mean = sum(g.n * g.mean for g in groups.values()) / n
    within = sum(g.scatter for g in groups.values())
    between = sum(g.n * np.outer(g.mean - mean, g.mean - mean) for g in groups.values())
    values, vectors = np.linalg.eig(np.linalg.pinv(within) @ between)
    order = np.argsort(values.real)[::-1]
    values, vectors = np.maximum(values.real[order], 0.0), vectors.real[:, order]
    k = min(components, len(groups) - 1, len(features))
    total = values.sum()
    return Projection(list(features), mean, vectors[:, :k], values[:k], values[:k] / total if total > 0 else np.zeros(k))


def reconstruction_by_k(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean squared reconstruction error and kept variance for every number of components.

    The error of k components is the variance left out, so no pass beyond the covariance is needed.
    """
    p = pca(df, features)
    m = moments(df, features)
    total, d = np.trace(m.scatter), len(features)
    kept = np.cumsum(p.variance) * (m.n - 1)
    rows = [(k + 1, float(max(total - kept[k], 0.0) / (m.n * d)), float(kept[k] / total)) for k in range(d)]
    return df.sparkSession.createDataFrame(rows, "components int, mse double, kept_variance double")


def reconstruction_error(df: DataFrame, p: Projection, output: str = "error") -> DataFrame:
    """Mean squared difference between a row and its projection back to the original columns."""
    scores = p.columns()
    error = F.lit(0.0)
    for i, name in enumerate(p.names):
        back = F.lit(float(p.mean[i]))
        for k, s in enumerate(scores):
            back = back + s * float(p.axes[i, k])
        gap = F.col(quoted(name)).cast("double") - back
        error = error + gap * gap / float(len(p.names))
    return df.withColumn(output, error)


def feature_errors(df: DataFrame, p: Projection) -> DataFrame:
    """Mean squared reconstruction error per feature, largest first."""
    cells = []
    scores = p.columns()
    for i, name in enumerate(p.names):
        back = F.lit(float(p.mean[i]))
        for k, s in enumerate(scores):
            back = back + s * float(p.axes[i, k])
        gap = F.col(quoted(name)).cast("double") - back
        cells.append(F.struct(F.lit(name).alias("feature"), (gap * gap).alias("e")))
    return df.select(F.inline(F.array(*cells))).groupBy("feature").agg(F.avg("e").alias("mse")).orderBy(F.desc("mse"), "feature")


def anomaly_flags(df: DataFrame, error: str, normal: Column, sigmas: float = 2.0) -> DataFrame:
    """Add ``threshold`` (mean + sigmas deviations of the normal rows' error) and ``flagged``."""
    e = F.when(normal, F.col(error))
    limit = df.agg(F.avg(e) + sigmas * F.stddev_pop(e))
    return df.withColumn("threshold", limit.scalar()).withColumn("flagged", F.col(error) > F.col("threshold"))


def anomaly_quality(flagged: DataFrame, anomalous: Column) -> DataFrame:
    """Precision, recall and F1 of the flags."""
    from plumbrule.operators.metrics import ratio

    tp, fp, fn = (F.count_if(c) for c in (F.col("flagged") & anomalous, F.col("flagged") & ~anomalous, ~F.col("flagged") & anomalous))
    s = flagged.agg(F.max("threshold").alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return s.select(
        "threshold",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        (F.col("tp") + F.col("fp")).alias("flagged"),
    )


def kernel_pca(df: DataFrame, features: Sequence[str], landmarks: np.ndarray, components: int = 2, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 1.0, output: str = "kpc") -> DataFrame:
    """Kernel principal components through landmark rows (the full method when the landmarks are all rows).

    ``landmarks`` is a small (m x d) array, e.g. an even sample; rows are projected in Arrow batches.
    """
    g = gamma if gamma is not None else 1.0 / len(features)

    def kern(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if kernel == "rbf":
            return np.exp(-g * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0.0))
        inner = a @ b.T
        return {"linear": lambda: inner, "poly": lambda: (g * inner + coef0) ** degree, "sigmoid": lambda: np.tanh(g * inner + coef0)}[kernel]()

    k = kern(landmarks, landmarks)
    row_mean, all_mean = k.mean(axis=0), k.mean()
    centred = k - row_mean[None, :] - row_mean[:, None] + all_mean
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(values)[::-1][:components]
    scale = vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-12))

    def project(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        kx = kern(x, landmarks)
        return pd.Series(list((kx - kx.mean(axis=1, keepdims=True) - row_mean[None, :] + all_mean) @ scale))

    fn = F.pandas_udf(project, "array<double>")
    return df.withColumn(output, fn(*[F.col(quoted(c)).cast("double") for c in features]))


def landmark_rows(df: DataFrame, features: Sequence[str], order: Sequence[str], size: int = 200) -> np.ndarray:
    """Evenly spaced rows as landmarks (at most ``size`` rows reach the driver)."""
    from plumbrule.operators.clean import even_sample

    rows = even_sample(df.dropna("any", subset=list(features)), order, size).orderBy(*map(quoted, order)).select(*[F.col(quoted(c)).cast("double") for c in features]).collect()
    return np.array([list(r) for r in rows], dtype=float)


