"""Column expressions used by models, scoring and reports; all stay inside generated code."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function that does not overflow for large negative numbers."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(slope * x)


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * (F.exp(x) - 1))


def soft_threshold(x: Column, by: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def total(array: str | Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def log_sum_exp(array: str | Column) -> Column:
    top = F.array_max(array)
    return top + F.ln(total(F.transform(array, lambda v: F.exp(v - top))))


def softmax(array: str | Column) -> Column:
    whole = log_sum_exp(array)
    return F.transform(array, lambda v: F.exp(v - whole))


def normalized(array: str | Column) -> Column:
    whole = total(array)
    return F.transform(array, lambda v: v / whole)


def argmax(array: str | Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def argmax_label(array: str | Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), argmax(array))


def prediction(probabilities: str | Column, labels: Sequence[str]) -> Column:
    """``struct<class, probabilities: map<label, p>>`` of a probability array."""
    names = F.array(*map(F.lit, labels))
    return F.struct(argmax_label(probabilities, labels).alias("class"), F.map_from_arrays(names, probabilities).alias("probabilities"))


def dot(columns: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, w in zip(columns, weights):
        out = out + F.col(f"`{c}`").cast("double") * float(w)
    return out


def safe_token(text: Column) -> Column:
    """Lower-case letters and digits, everything else one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def word_count(text: str | Column) -> Column:
    """White-space separated words; blank text has none."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def utc_date(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def hashed_normal(seed: int, *parts: Column | str) -> Column:
    """Box-Muller normal number from a hash of the parts, the same on every run and cluster."""
    u = [F.xxhash64(F.lit(seed + j), *parts).cast("double") / 2.0**64 + 0.5 for j in (0, 1)]
    return F.sqrt(-2 * F.ln(F.greatest(u[0], F.lit(1e-12)))) * F.cos(2 * math.pi * u[1])
