"""Exact best first split over every midpoint of every feature, from distributed running class counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import as_double, field_types, quoted
from plumbrule.core.ordering import stacked_running
from plumbrule.operators.prep import categories


def _impurity(counts: list[Column], n: Column, criterion: str) -> Column:
    out = F.lit(0.0)
    for c in counts:
        p = F.try_divide(c, n)
        out = out + F.coalesce(p * F.log2(p) if criterion == "entropy" else p * p, F.lit(0.0))
    return -out if criterion == "entropy" else 1 - out


def _next_values(steps: DataFrame) -> DataFrame:
    """Add the next larger value of the same feature.

    Value k of a feature meets value k-1 through its rank among the distinct values, which the running
    count provides, so no window spans a whole feature.
    """
    nxt = steps.select("column", (F.col("cum_distinct") - 1).alias("cum_distinct"), F.col("value").alias("next_value"))
    return steps.join(nxt, ["column", "cum_distinct"])


def _ranked_values(df: DataFrame, features: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    types = field_types(df)
    rows = df.select(*[as_double(c, types[c]).alias(c) for c in features], *[e.alias(f"_{m}") for m, e in measures.items()])
    steps = stacked_running(rows, features, {m: F.col(f"_{m}") for m in measures})
    # rank of each distinct value inside its feature: running count over the already aggregated values
    ranked = stacked_running(steps.select("column", "value"), ["value"], {"distinct": F.lit(1)}, by=["column"], key="_which")
    return steps.join(ranked.select("column", "value", "cum_distinct"), ["column", "value"])


def best_split_class(df: DataFrame, label: str, features: Sequence[str], criterion: str = "gini", top: int = 1) -> DataFrame:
    """Feature, threshold and impurity gain of the best split; the first feature and value win ties."""
    classes = categories(df, label)
    steps = _ranked_values(df, features, {f"k{i}": (F.col(quoted(label)) == F.lit(c)).cast("long") for i, c in enumerate(classes)})
    placed = _next_values(steps)
    left = [F.col(f"cum_k{i}") for i in range(len(classes))]
    total = [F.col(f"total_k{i}") for i in range(len(classes))]
    right = [t - c for t, c in zip(total, left)]
    n_left, n = sum(left, F.lit(0)), sum(total, F.lit(0))
    n_right = n - n_left
    child = n_left / n * _impurity(left, n_left, criterion) + n_right / n * _impurity(right, n_right, criterion)
    return _top(placed.withColumn("gain", _impurity(total, n, criterion) - child), features, top)


def best_split_mse(df: DataFrame, target: str, features: Sequence[str], top: int = 1) -> DataFrame:
    """The same for a numeric target: largest drop of the mean squared error."""
    y = as_double(target, field_types(df)[target])
    shift = df.agg(F.avg(y).alias("m")).first()["m"] or 0.0
    z = y - F.lit(shift)
    steps = _ranked_values(df, features, {"n": F.lit(1).cast("double"), "s": z, "q": z * z})
    placed = _next_values(steps)

    def sse(n: Column, s: Column, q: Column) -> Column:
        return q - F.try_divide(s * s, n)

    c = {m: F.col(f"cum_{m}") for m in "nsq"}
    t = {m: F.col(f"total_{m}") for m in "nsq"}
    r = {m: t[m] - c[m] for m in "nsq"}
    gain = (sse(t["n"], t["s"], t["q"]) - sse(c["n"], c["s"], c["q"]) - sse(r["n"], r["s"], r["q"])) / t["n"]
    return _top(placed.withColumn("gain", gain), features, top)


def _top(splits: DataFrame, features: Sequence[str], top: int) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, features)), F.col("column"))
    best = splits.where(F.col("gain") > 0).select(
        F.col("column").alias("feature"), ((F.col("value") + F.col("next_value")) / 2.0).alias("threshold"), "gain", order.alias("_o")
    )
    return best.orderBy(F.desc(F.round("gain", 12)), "_o", "threshold").limit(top).drop("_o")
