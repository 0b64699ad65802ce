"""Exploration tables: counts, histograms, quartiles, densities, correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import as_double, broadcast_if_small, column_rows, field_types, quoted
from plumbrule.core.moments import moments
from plumbrule.core.ordering import exact_quantiles
from plumbrule.operators.profile import value_counts

MAX_PIVOT = 10_000


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.select("*", (F.col("n") / total.scalar()).alias("share"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    types = field_types(df)
    x = {c: as_double(c, types[c]) for c in columns}
    facts = column_rows(
        df,
        columns,
        {
            "n": {c: F.count(x[c]) for c in columns},
            "mean": {c: F.avg(x[c]) for c in columns},
            "std": {c: F.stddev_samp(x[c]) for c in columns},
            "low": {c: F.min(x[c]) for c in columns},
            "high": {c: F.max(x[c]) for c in columns},
        },
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select("column", "q0", "q1", "q2")
    return facts.join(quartiles, "column", "left").select(
        "column", "n", "mean", "std", "low", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "high"
    )


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, distinct values, most frequent value (smallest on a tie) and its count per text column."""
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("sval")))
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("unique"), best.alias("b"))
        .select("column", "n", "unique", F.col("b.sval").alias("top"), (-F.col("b.k")).alias("freq"))
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence | None = None) -> DataFrame:
    """Two-way counts in wide form with zeros for absent pairs."""
    if values is None:
        found = df.select(quoted(columns)).where(F.col(quoted(columns)).isNotNull()).distinct().limit(MAX_PIVOT + 1).collect()
        if len(found) > MAX_PIVOT:
            raise ValueError(f"{columns} has more than {MAX_PIVOT} values: pass the wanted ones")
        values = sorted(r[0] for r in found)
    return df.groupBy(quoted(rows)).pivot(columns, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def class_histogram(df: DataFrame, label: str, column: str, bins: int = 25) -> DataFrame:
    """Counts per class and equal-width bin between the overall minimum and maximum."""
    x = as_double(column, field_types(df)[column])
    edge = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    rows = df.select(F.col(quoted(label)), x.alias("x"), edge.alias("e")).where(F.col("x").isNotNull())
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("e.lo")) / width), F.lit(bins - 1))).otherwise(0)
    return (
        rows.select(quoted(label), at.cast("int").alias("bin"))
        .groupBy(quoted(label), "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_boxplot(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Quartiles per class and column, and the outermost values within 1.5 interquartile ranges."""
    box = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by=[label]).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    types = field_types(df)
    cells = df.select(
        F.col(quoted(label)),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), as_double(c, types[c]).alias("x")) for c in columns])),
    ).where(F.col("x").isNotNull())
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("x").between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        cells.join(broadcast_if_small(box), [label, "column"])
        .groupBy(quoted(label), "column")
        .agg(
            *[F.max(q).alias(q) for q in ("q25", "q50", "q75")],
            F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], at_once: int = 200) -> DataFrame:
    """Pearson correlation of every pair of columns, long form, each over the rows that hold both.

    One pass per ``at_once`` pairs; a pair without spread has no correlation.
    """
    types = field_types(df)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    found: dict[tuple[int, int], float | None] = {}
    for begin in range(0, len(pairs), at_once):
        some = pairs[begin : begin + at_once]
        row = df.agg(*[F.corr(as_double(columns[i], types[columns[i]]), as_double(columns[j], types[columns[j]])).alias(f"r{k}") for k, (i, j) in enumerate(some)]).first()
        found.update({pair: r if r is not None and np.isfinite(r) else None for pair, r in zip(some, row)})
    rows = [(a, b, found[max(i, j), min(i, j)]) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def class_kde(df: DataFrame, label: str, column: str, points: int = 200) -> DataFrame:
    """Gaussian density estimate per class on an even grid between the overall extremes.

    Equal values are merged first; each (class, value) then meets the fixed grid and is summed at once
    on the map side, so the shuffle carries one row per class and grid point.
    """
    x = as_double(column, field_types(df)[column])
    counts = df.where(x.isNotNull()).groupBy(F.col(quoted(label)).alias("label"), x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    per_class = df.groupBy(F.col(quoted(label)).alias("label")).agg(F.count(x).alias("size"), F.stddev_samp(x).alias("sd"))
    edge = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    bandwidth = F.greatest(
        F.when(F.coalesce("sd", F.lit(0.0)) > 0, 1.06 * F.col("sd") * F.pow(F.col("size").cast("double"), F.lit(-0.2))).otherwise(1.0),
        F.lit(1e-6),
    )
    grid = F.col("e.lo") + F.col("step") * ((F.col("e.hi") - F.col("e.lo")) / (points - 1))
    z = (grid - F.col("x")) / F.col("h")
    dense = (
        counts.join(broadcast_if_small(per_class.select("label", "size", bandwidth.alias("h"))), "label")
        .withColumn("e", edge)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step"))
        .select("label", "step", "size", "h", grid.alias("at"), (F.col("n") * F.exp(-0.5 * z * z)).alias("k"))
    )
    return (
        dense.groupBy("label", "step")
        .agg(F.max("at").alias("at"), (F.sum("k") / F.max("size") / (F.max("h") * float(np.sqrt(2 * np.pi)))).alias("density"))
    )


def skew_notes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness and whether it looks Gaussian."""
    types = field_types(df)
    n = {c: F.count(as_double(c, types[c])).cast("double") for c in columns}
    skew = {
        c: F.when(n[c] > 2, F.skewness(as_double(c, types[c])) * F.sqrt(n[c] * (n[c] - 1)) / (n[c] - 2)) for c in columns
    }
    return column_rows(df, columns, {"skewness": skew}).select(
        F.col("column").alias("feature"),
        "skewness",
        F.when(F.abs("skewness") < 0.5, "approximately Gaussian").otherwise("skewed").alias("note"),
    )


def class_moments(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Prior per class, and mean and population variance per class and column."""
    types = field_types(df)
    total = df.where(F.col(quoted(label)).isNotNull()).agg(F.count(F.lit(1)))
    wide = (
        df.where(F.col(quoted(label)).isNotNull())
        .groupBy(F.col(quoted(label)).alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(as_double(c, types[c])).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.var_pop(as_double(c, types[c])).alias(f"v{i}") for i, c in enumerate(columns)],
        )
    )
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)]
    return wide.select("label", "n", (F.col("n") / total.scalar()).alias("prior"), F.inline(F.array(*cells)))


def metric_minmax(metrics: DataFrame, key: str, columns: Sequence[str], lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Rescale each metric to [0, 1] over the table; a constant metric gives 0, inverted ones 1 - x."""
    edge = metrics.agg(
        F.struct(*[x for c in columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).alias("e")
    ).scalar()
    out = metrics.withColumn("_e", edge)

    def scaled(c: str) -> Column:
        span = F.col(f"_e.hi_{c}") - F.col(f"_e.lo_{c}")
        x = (F.col(c) - F.col(f"_e.lo_{c}")) / F.when(span == 0, 1.0).otherwise(span)
        return (1 - x if c in lower_is_better else x).alias(c)

    return out.select(key, *[scaled(c) for c in columns])


def run_summary(runs: DataFrame, group: str, value: str) -> DataFrame:
    """Summary of a run table per group: count, mean, deviation, extremes and quartiles."""
    facts = runs.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    q = exact_quantiles(runs, [value], [0.25, 0.5, 0.75], by=[group]).select(
        group, F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75")
    )
    return facts.join(q, group)
