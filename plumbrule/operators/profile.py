"""Column and table profiles, target and feature suggestions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrule.core.frames import (
    as_double,
    column_rows,
    field_types,
    is_numeric,
    long_values,
    quoted,
    require_flat,
    value_of,
    with_nulls,
)

MAX_TARGET_CLASSES = 20
CLASS_RATIO = 0.15

# Names and name parts that mark a likely target column.
EXACT_TARGET_NAMES = ("target", "label", "class", "type", "category", "outcome")
TARGET_NAME_PARTS = ("class", "target", "label")
OUTCOME_NAME_PARTS = ("risk", "level", "status", "outcome")
TARGET_WORDS = ("target", "label", "class", "type", "category", "outcome")

SLOTS = ("lval", "dval", "sval")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per distinct present value of every column: ``column, lval, dval, sval, n``."""
    cells = long_values(df, list(columns or df.columns)).where(~F.col("is_missing"))
    return cells.groupBy("column", *SLOTS).agg(F.count(F.lit(1)).alias("n"))


def distinct_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("distinct_values"), F.min("n").alias("min_count"), F.max("n").alias("max_count"))
    )


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column with everything the rules below look at.

    One wide aggregate gives counts and moments; one grouped pass over the stacked values gives exact
    distinct counts (``approximate=True`` folds a sketch into the first pass instead).
    """
    require_flat(df)
    names = list(columns or df.columns)
    types = field_types(df)
    none = F.lit(None).cast("double")

    def numeric(fn, c) -> Column:
        return fn(as_double(c, types[c])) if is_numeric(types[c]) else F.max(none)

    measures = {
        "n_rows": {c: F.count(F.lit(1)) for c in names},
        "present": {c: F.count(value_of(c, types[c])) for c in names},
        "mean": {c: numeric(F.avg, c) for c in names},
        "std": {c: numeric(F.stddev_pop, c) for c in names},
        "low": {c: numeric(F.min, c) for c in names},
        "high": {c: numeric(F.max, c) for c in names},
        "example": {c: F.min(value_of(c, types[c])).cast("string") for c in names},
    }
    if approximate:
        measures["distinct_values"] = {c: F.approx_count_distinct(value_of(c, types[c])) for c in names}
    rows = column_rows(df, names, measures)
    if not approximate:
        rows = rows.join(distinct_stats(df, names), "column", "left")
    facts = F.create_map(
        *[x for c in names for x in (F.lit(c), F.struct(F.lit(types[c].simpleString()).alias("dtype"),
                                                         F.lit(is_numeric(types[c])).alias("is_number"),
                                                         F.lit(isinstance(types[c], T.StringType)).alias("is_text")))]
    )
    return (
        rows.withColumn("_f", facts[F.col("column")])
        .select("*", "_f.dtype", "_f.is_number", "_f.is_text")
        .drop("_f")
        .withColumn("missing", F.col("n_rows") - F.col("present"))
        .withColumn("missing_pct", F.col("missing") / F.greatest(F.col("n_rows"), F.lit(1)))
        .fillna(0, subset=["distinct_values"] + ([] if approximate else ["min_count", "max_count"]))
    )


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    return column_stats(df, approximate=approximate).select(
        "position",
        "column",
        "dtype",
        "missing",
        "missing_pct",
        F.col("distinct_values").alias("unique"),
        "example",
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` and the number of rows beyond the first of each identical group."""
    groups = with_nulls(df).groupBy(*map(quoted, df.columns)).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def profile_table(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows."""
    types = field_types(df)
    missing = F.lit(0)
    for c, t in types.items():
        missing = missing + value_of(c, t).isNull().cast("long")
    cells = with_nulls(df).withColumn("_missing", missing)
    groups = cells.groupBy(*map(quoted, df.columns)).agg(
        F.count(F.lit(1)).alias("_copies"), F.sum("_missing").alias("_missing")
    )
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.lit(len(types)).alias("n_columns"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def task_type() -> Column:
    """Task suggested by the counts of a :func:`column_stats` row."""
    few = (F.col("distinct_values") <= MAX_TARGET_CLASSES) & (
        F.col("distinct_values") / F.greatest(F.col("present"), F.lit(1)) <= CLASS_RATIO
    )
    return (
        F.when(F.col("distinct_values") <= 1, "invalid")
        .when(F.col("is_number") & ~few, "regression")
        .otherwise("classification")
    )


def guess_task_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return column_stats(df, columns).select(
        "column", F.col("distinct_values").alias("unique"), "present", task_type().alias("task_type")
    )


def _name_has(parts: Iterable[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.lower("column").contains(p)
    return hit


def suggest_targets(df: DataFrame) -> DataFrame:
    """Likely target columns with a score; ``rank`` orders them (ties keep the column order)."""
    stats = column_stats(df).withColumn("task_type", task_type())
    points = [
        (F.col("distinct_values").between(2, MAX_TARGET_CLASSES), 2.0),
        (F.col("missing") == 0, 1.0),
        (F.lower("column").isin(*EXACT_TARGET_NAMES), 2.0),
        (_name_has(TARGET_NAME_PARTS), 1.0),
        (_name_has(OUTCOME_NAME_PARTS), 2.0),
        (F.col("position") == len(df.columns) - 1, 1.0),
        ((F.col("task_type") == "regression") & F.col("is_number"), 0.5),
    ]
    score = F.lit(0.0)
    for when, worth in points:
        score = score + F.when(when, worth).otherwise(0.0)
    return (
        stats.where(F.col("task_type") != "invalid")
        .select("position", "column", "task_type", F.col("distinct_values").alias("unique"), "missing_pct", score.alias("score"))
        .orderBy(F.desc("score"), "position")
    )


def suggest_features(df: DataFrame, target: str) -> DataFrame:
    """Usable feature columns and why the others are not."""
    reason = (
        F.when(F.col("distinct_values") <= 1, "constant")
        .when(F.col("missing_pct") >= 0.8, "too many missing values")
        .otherwise("usable")
    )
    names = [c for c in df.columns if c != target]
    return (
        column_stats(df, names)
        .withColumn("reason", reason)
        .select(
            "position",
            "column",
            "dtype",
            F.col("distinct_values").alias("unique"),
            "missing_pct",
            (F.col("reason") == "usable").alias("usable"),
            "reason",
        )
        .orderBy("position")
    )


def validate_targets(df: DataFrame, columns: Sequence[str] | None = None, cv_splits: int = 5) -> DataFrame:
    """Can each column serve as a class target with a stratified holdout and ``cv_splits`` folds?"""
    n, k, least = F.col("present"), F.col("distinct_values"), F.col("min_count")
    limit = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(n / 7)))
    continuous = F.col("is_number") & (k >= 20) & (k / F.greatest(n, F.lit(1)) > 0.10)
    reason = (
        F.when(n == 0, "no values")
        .when(k < 2, "fewer than two classes")
        .when(continuous, "continuous")
        .when(k > limit, "too many classes")
        .when(least < 2, "class with a single row")
        .when(least < cv_splits + 2, "smallest class too small for the folds")
    )
    return column_stats(df, columns).select(
        "position",
        "column",
        "is_number",
        reason.isNull().alias("valid"),
        reason.alias("reason"),
        continuous.alias("appears_continuous"),
        k.alias("n_classes"),
        least.alias("min_class_count"),
    )


def recommend_targets(df: DataFrame, cv_splits: int = 5) -> DataFrame:
    """Valid class targets, best first: telling name, then text before numbers, then fewer classes."""
    return (
        validate_targets(df, cv_splits=cv_splits)
        .where("valid")
        .select("column", _name_has(TARGET_WORDS).alias("named"), "is_number", "n_classes", "position")
        .orderBy(F.desc("named"), "is_number", "n_classes", "position")
    )
