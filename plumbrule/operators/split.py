"""Reproducible holdouts, folds, learning subsets and resampling weights.

Row order inside a class comes from a hash (or another key with known range), so that even a class
holding most of the table is numbered by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import field_types, quoted, value_of
from plumbrule.core.ordering import ordered_index, range_count, spread_index

MIX, HASH_BITS = "_mix", 63


def hash_order(df: DataFrame, key: Sequence[str], seed: int = 42) -> tuple[DataFrame, Column]:
    """Add ``_mix`` (a seeded hash of the key) and return the range number of that hash."""
    ranges = range_count(df)
    mixed = df.withColumn(MIX, F.xxhash64(F.lit(seed), *map(quoted, key)))
    return mixed, F.floor((F.col(MIX).cast("double") / 2.0**HASH_BITS + 1.0) / 2.0 * ranges).cast("long")


def modular_order(df: DataFrame, key: str, factor: int = 7919, modulus: int = 10007) -> tuple[DataFrame, Column]:
    """Like :func:`hash_order` with ``key * factor % modulus`` in place of the hash."""
    ranges = range_count(df)
    mixed = df.withColumn(MIX, (F.col(quoted(key)) * factor) % modulus)
    return mixed, F.floor(F.col(MIX) * ranges / modulus).cast("long")


def _class_index(df: DataFrame, label: str, key: Sequence[str], seed: int, modular: bool) -> DataFrame:
    usable = df.where(value_of(label, field_types(df)[label]).isNotNull())
    mixed, spread = modular_order(usable, key[0]) if modular else hash_order(usable, key, seed)
    return spread_index(mixed, [MIX, *key], spread, by=[label], name="_i", total="_n").drop(MIX)


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test_share: float = 0.2, seed: int = 42, modular: bool = False) -> DataFrame:
    """Add ``is_test``: the first ``ceil(test_share * class size)`` rows of each class in hashed order."""
    placed = _class_index(df, label, key, seed, modular)
    return placed.withColumn("is_test", F.col("_i") < F.ceil(F.col("_n") * F.lit(test_share) - 1e-9)).drop("_i", "_n")


def stratified_folds(df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 42, modular: bool = False) -> DataFrame:
    """Add ``fold``: rows of each class dealt out in hashed order."""
    placed = _class_index(df, label, key, seed, modular)
    return placed.withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i", "_n")


def random_split(df: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test`` by a hash threshold; needs no shuffle."""
    u = F.xxhash64(F.lit(seed), *map(quoted, key)).cast("double") / 2.0**64 + 0.5
    return df.withColumn("is_test", u < test_share)


def random_folds(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *map(quoted, key)), F.lit(k)).cast("int"))


def safe_cv_splits(df: DataFrame, label: str, task: str = "classification") -> DataFrame:
    """One row: fold count that every class can fill, between 2 and 5."""
    counts = df.where(F.col(quoted(label)).isNotNull()).groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n"))
    five = F.lit(5).cast("long")
    folds = five if task == "regression" else F.greatest(F.lit(2), F.least(five, F.min("n")))
    return counts.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_class"), F.max(folds).alias("folds") if task == "regression" else folds.alias("folds"))


def learning_subsets(folded: DataFrame, label: str, key: Sequence[str], fractions: Sequence[float], k: int = 5, modular: bool = False) -> DataFrame:
    """Rows of growing training prefixes: one row per (row, held-out fold, fraction) it belongs to.

    The prefix is taken within each class in hashed order, so classes keep their shares.
    """
    train = folded.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("held_out")).where(F.col("fold") != F.col("held_out"))
    mixed, spread = modular_order(train, key[0]) if modular else hash_order(train, key, 1)
    placed = spread_index(mixed, [MIX, *key], spread, by=["held_out", label], name="_i", total="_n").drop(MIX)
    sizes = F.array(*[F.lit(float(f)) for f in fractions])
    inside = F.filter(sizes, lambda f: F.col("_i") < F.ceil(F.col("_n") * f - 1e-9))
    return placed.select("*", F.explode(inside).alias("fraction")).drop("_i", "_n")


def learning_subset_counts(df: DataFrame, label: str, key: Sequence[str], fractions: Sequence[float], k: int = 5, modular: bool = False) -> DataFrame:
    """Training rows per held-out fold and fraction; empty if the table is too small for a curve."""
    facts = df.where(F.col(quoted(label)).isNotNull()).groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.min("n").alias("least")).first()
    small = (facts["rows"] or 0) < 50 or (facts["least"] or 0) < 10
    folded = stratified_folds(df, label, key, k, modular=modular)
    rows = learning_subsets(folded, label, key, fractions, k, modular)
    counts = rows.groupBy("held_out", "fraction").agg(F.count(F.lit(1)).alias("n_train"))
    return counts.where(F.lit(not small))


def chrono_split(df: DataFrame, order: Sequence[str], train: float = 0.70, validation: float = 0.85) -> DataFrame:
    """Add ``part`` (train / validation / test) by position in the row order."""
    placed = ordered_index(df, order, name="_i", total="_n")
    part = (
        F.when(F.col("_i") < F.floor(F.col("_n") * train + 1e-9), "train")
        .when(F.col("_i") < F.floor(F.col("_n") * validation + 1e-9), "validation")
        .otherwise("test")
    )
    return placed.withColumn("part", part).drop("_i", "_n")


def member_weight(key: Sequence[str], estimator: Column, seed: int = 42, replace: bool = True, share: float = 1.0) -> Column:
    """Resampling weight of a row in an estimator, a function of the row's key; weight 0 means out of bag.

    With replacement the weight is Poisson(share) of a hashed uniform number, the large-table form of a
    bootstrap; without, each row joins an estimator with probability ``share``.
    """
    u = F.xxhash64(F.lit(seed), estimator, *map(quoted, key)).cast("double") / 2.0**64 + 0.5
    if not replace:
        return (u < share).cast("double")
    steps = np.cumsum([np.exp(-share) * share**i / float(np.prod(np.arange(1, i + 1))) for i in range(12)])
    weight: Column = F.lit(0.0)
    for s in steps:
        weight = weight + (u > float(s)).cast("double")
    return weight


def bootstrap_weights(df: DataFrame, key: Sequence[str], estimators: int, seed: int = 42, replace: bool = True, share: float = 1.0) -> DataFrame:
    """One row per (row, estimator) with its :func:`member_weight`."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))).alias("estimator"))
    return rows.withColumn("weight", member_weight(key, F.col("estimator"), seed, replace, share))


def feature_subsets(features: Sequence[str], estimators: int, size: float | int, seed: int = 42) -> list[list[str]]:
    """A seeded feature list per estimator; ``size`` is a share (float) or a count (int)."""
    rng = np.random.default_rng(seed)
    k = max(1, int(round(size * len(features)))) if isinstance(size, float) else min(size, len(features))
    return [sorted(rng.choice(features, size=k, replace=False).tolist(), key=list(features).index) for _ in range(estimators)]
