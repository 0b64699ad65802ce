"""Sums of products: everything a least-squares, covariance or scatter computation needs from the data."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import as_double, field_types, quoted

WIDE = 24
MAX_GROUPS = 10_000


@dataclass
class Moments:
    """Row count, means and centred sums of products of the named columns."""

    names: list[str]
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def pick(self, names: Sequence[str]) -> Moments:
        at = [self.names.index(c) for c in names]
        return Moments(list(names), self.n, self.mean[at], self.scatter[np.ix_(at, at)])

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.scatter / (self.n - ddof)

    def raw(self) -> np.ndarray:
        """Uncentred sums of products."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)


def array_columns(df: DataFrame, column: str, width: int, prefix: str = "f") -> DataFrame:
    """Spread a fixed-width numeric array over columns ``f0 .. f<width-1>``."""
    return df.select("*", *[F.col(column)[i].cast("double").alias(f"{prefix}{i}") for i in range(width)])


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Two passes (means, then centred products) over the rows in which no column is missing."""
    columns = list(columns)
    types = field_types(df)
    base = df.select(*[as_double(c, types[c]).alias(f"x{i}") for i, c in enumerate(columns)]).dropna("any")
    d = len(columns)
    head = base.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]).first()
    mean = np.array([head[f"m{i}"] if head[f"m{i}"] is not None else 0.0 for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    scatter = np.zeros((d, d))
    if d <= WIDE:
        row = base.agg(
            *[
                F.sum((F.col(f"x{i}") - F.lit(float(mean[i]))) * (F.col(f"x{j}") - F.lit(float(mean[j])))).alias(f"p{i}_{j}")
                for i, j in pairs
            ]
        ).first()
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = row[f"p{i}_{j}"] or 0.0
    else:
        for r in _block_products(base, mean).collect():
            scatter[r["i"]] = r["line"]
    return Moments(columns, float(head["n"]), mean, scatter)


def _block_products(base: DataFrame, mean: np.ndarray) -> DataFrame:
    """Partial products per task, then one sum per matrix line: wide tables stay out of codegen limits."""
    d = len(mean)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - mean
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(d), "line": list(total)})

    parts = base.mapInPandas(partial, "i int, line array<double>")
    return parts.groupBy("i").agg(F.array(*[F.sum(F.col("line")[j]) for j in range(d)]).alias("line"))


def grouped_moments(df: DataFrame, columns: Sequence[str], by: str) -> dict[object, Moments]:
    """Moments per class; refuses a key with more than ``MAX_GROUPS`` values."""
    columns = list(columns)
    types = field_types(df)
    d = len(columns)
    base = df.select(
        F.col(quoted(by)).alias("g"), *[as_double(c, types[c]).alias(f"x{i}") for i, c in enumerate(columns)]
    ).dropna("any")
    shift = base.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]).first()
    centre = np.array([shift[f"m{i}"] or 0.0 for i in range(d)])
    x = [F.col(f"x{i}") - F.lit(float(centre[i])) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = (
        base.groupBy("g")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(x[i]).alias(f"s{i}") for i in range(d)],
            *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .limit(MAX_GROUPS + 1)
        .collect()
    )
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"{by} has more than {MAX_GROUPS} classes")
    out = {}
    for r in sorted(rows, key=lambda r: r["g"]):
        n = float(r["n"])
        s = np.array([r[f"s{i}"] for i in range(d)])
        p = np.zeros((d, d))
        for i, j in pairs:
            p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r["g"]] = Moments(columns, n, centre + s / n, p - np.outer(s, s) / n)
    return out
