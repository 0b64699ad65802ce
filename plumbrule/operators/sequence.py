"""Windows over ordered series.  Long series are cut into overlapping chunks, so one series may be any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbrule.core.frames import broadcast_if_small, quoted
from plumbrule.core.moments import Moments, moments
from plumbrule.core.ordering import neighbour_chunks


def sliding_windows(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str | Column, width: int, horizon: int = 1) -> DataFrame:
    """``inputs`` = rows s .. s+width-1 and ``target`` = row s+width+horizon-1, for every full window.

    ``value`` may be a column or an expression such as a struct or array of several features.
    """
    chunks, w = neighbour_chunks(df, order, by, after=width + horizon - 1)
    v = F.col(quoted(value)) if isinstance(value, str) else value
    out = chunks.withColumn("inputs", F.collect_list(v).over(w.rowsBetween(0, width - 1))).withColumn(
        "target", F.lead(v, width + horizon - 1).over(w)
    )
    has_target = F.lead(F.lit(1), width + horizon - 1).over(w).isNotNull()
    return out.withColumn("_full", has_target).where("_full AND _own").select(*map(quoted, by), F.col("_idx").alias("start"), "inputs", "target")


def multi_horizon(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, width: int, horizon: int) -> DataFrame:
    """``inputs`` as above and ``targets`` = the next ``horizon`` values."""
    chunks, w = neighbour_chunks(df, order, by, after=width + horizon - 1)
    v = F.col(quoted(value))
    out = (
        chunks.withColumn("inputs", F.collect_list(v).over(w.rowsBetween(0, width - 1)))
        .withColumn("targets", F.collect_list(v).over(w.rowsBetween(width, width + horizon - 1)))
        .withColumn("_full", F.lead(F.lit(1), width + horizon - 1).over(w).isNotNull())
    )
    return out.where("_full AND _own").select(*map(quoted, by), F.col("_idx").alias("start"), "inputs", "targets")


def horizon_band(df: DataFrame, predicted: str, actual: str, z: float = 1.96) -> DataFrame:
    """Population deviation of the residual per forecast step and the half-width of its band."""
    steps = df.select(F.posexplode(F.zip_with(predicted, actual, lambda p, a: p - a)).alias("step", "residual"))
    return steps.groupBy("step").agg(F.stddev_pop("residual").alias("std"), (F.stddev_pop("residual") * z).alias("band"), F.count(F.lit(1)).alias("n"))


def standardize_series(df: DataFrame, by: Sequence[str], value: str, output: str = "scaled") -> DataFrame:
    """(x - mean) / population deviation within each series, by a grouped aggregate and a join."""
    facts = df.groupBy(*map(quoted, by)).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    sd = F.when(F.coalesce("_s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s"))
    return df.join(broadcast_if_small(facts), list(by)).withColumn(output, (F.col(quoted(value)) - F.col("_m")) / sd).drop("_m", "_s")


def lag_table(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, lags: int) -> DataFrame:
    """Rows with all lags present: ``lag1`` (latest) .. ``lagN`` and the value as ``y``."""
    chunks, w = neighbour_chunks(df, order, by, before=lags)
    v = F.col(quoted(value)).cast("double")
    out = chunks.withColumns({"y": v, **{f"lag{i}": F.lag(v, i).over(w) for i in range(1, lags + 1)}})
    return out.where(F.col("_own") & F.col(f"lag{lags}").isNotNull())


def solve_ridge(m: Moments, xs: Sequence[str], y: str, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    at, j = [m.names.index(c) for c in xs], m.names.index(y)
    a = m.scatter[np.ix_(at, at)] + alpha * np.eye(len(at))
    b = m.scatter[at, j]
    w = np.linalg.solve(a, b) if np.linalg.cond(a) < 1e12 else np.linalg.lstsq(a, b, rcond=None)[0]
    return w, float(m.mean[j] - w @ m.mean[at])


def fit_autoregression(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, lags: int, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """Least-squares coefficients of the last ``lags`` values, fitted over all series."""
    table = lag_table(df, by, order, value, lags)
    names = [f"lag{i}" for i in range(1, lags + 1)]
    return solve_ridge(moments(table, [*names, "y"]), names, "y", alpha)


def baseline_comparison(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, lags: int) -> DataFrame:
    """MSE and MAE of the autoregression, of the last value and of the window mean."""
    w, b = fit_autoregression(df, by, order, value, lags)
    table = lag_table(df, by, order, value, lags)
    names = [f"lag{i}" for i in range(1, lags + 1)]
    fit: Column = F.lit(b)
    mean: Column = F.lit(0.0)
    for n, c in zip(names, w):
        fit = fit + F.col(n) * float(c)
        mean = mean + F.col(n) / float(lags)
    guesses = {"autoregression": fit, "last value": F.col("lag1"), "window mean": mean}
    cells = F.array(*[F.struct(F.lit(k).alias("model"), (g - F.col("y")).alias("e")) for k, g in guesses.items()])
    return table.select(F.inline(cells)).groupBy("model").agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"), F.count("e").alias("n"))


def recursive_forecast(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, weights: Sequence[float], intercept: float, steps: int) -> DataFrame:
    """Feed each prediction back: an array of ``steps`` values per series with enough history.

    Only the last rows of each series travel (a top-k filter that Spark applies before the shuffle), and
    the recursion itself is an array expression.
    """
    lags = len(weights)
    last = Window.partitionBy(*map(quoted, by)).orderBy(*[F.desc(quoted(o)) for o in order])
    recent = df.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= lags)
    state = recent.groupBy(*map(quoted, by)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(quoted(value)).cast("double").alias("v")))), lambda s: s["v"]).alias("lagged")
    )
    w = F.array(*[F.lit(float(x)) for x in weights])

    def step(history: Column, _k: Column) -> Column:
        nxt = F.aggregate(F.zip_with(F.slice(history, 1, lags), w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, x: s + x)
        return F.concat(F.array(nxt), history)

    full = state.where(F.size("lagged") == lags)
    made = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("lagged"), step)
    return full.select(*map(quoted, by), F.reverse(F.slice(made, 1, steps)).alias("forecast"))
