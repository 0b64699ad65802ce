"""Two-table distribution comparison, all columns of a kind in one grouped job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import column_rows, field_types, is_numeric, long_values, quoted, value_of
from plumbrule.core.ordering import stacked_running
from plumbrule.functions.significance import chi2_sf, kolmogorov_sf
from plumbrule.operators.schema_rules import issue, issues_from, names_as_issues

MISSING = "<MISSING>"
SIDE = "_is_new"
RESULT = (
    "column", "test", "statistic", "dof", "p_value", "drifted", "reference_mean", "new_mean",
    "reference_std", "new_std", "total_variation_distance", "low_expected_counts",
)


def both_sides(reference: DataFrame, new: DataFrame, columns: Sequence[str], text: bool = False) -> DataFrame:
    """The two tables stacked, with ``_is_new`` telling them apart."""
    rt, nt = field_types(reference), field_types(new)

    def side(df, types, flag):
        cols = []
        for c in columns:
            v = value_of(c, types[c])
            if text and (str(rt[c]) != str(nt[c]) or not is_numeric(rt[c])):
                v = F.coalesce(v.cast("string"), F.lit(MISSING))
            cols.append(v.alias(c))
        return df.select(F.lit(flag).alias(SIDE), *cols)

    return side(reference, rt, 0).unionByName(side(new, nt, 1))


def numeric_drift(reference: DataFrame, new: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic of each column, with means and population deviations."""
    rows = both_sides(reference, new, columns)
    side = F.col(SIDE)
    steps = stacked_running(rows, columns, {"ref": (side == 0).cast("long"), "new": (side == 1).cast("long")})
    gap = F.abs(F.try_divide(F.col("cum_ref"), F.col("total_ref")) - F.try_divide(F.col("cum_new"), F.col("total_new")))
    found = steps.groupBy("column").agg(
        F.max(gap).alias("statistic"), F.max("total_ref").alias("n_ref"), F.max("total_new").alias("n_new")
    )

    def only(c: str, flag: int) -> Column:
        return F.when(side == flag, F.col(quoted(c)).cast("double"))

    facts = column_rows(
        rows,
        columns,
        {
            "reference_mean": {c: F.avg(only(c, 0)) for c in columns},
            "new_mean": {c: F.avg(only(c, 1)) for c in columns},
            "reference_std": {c: F.stddev_pop(only(c, 0)) for c in columns},
            "new_std": {c: F.stddev_pop(only(c, 1)) for c in columns},
        },
    )
    p = F.when(F.col("statistic").isNotNull(), kolmogorov_sf(F.col("statistic"), F.col("n_ref"), F.col("n_new")))
    return (
        facts.join(found, "column", "left")
        .withColumn("p_value", p)
        .select(
            "column",
            F.lit("kolmogorov-smirnov").alias("test"),
            "statistic",
            F.lit(None).cast("long").alias("dof"),
            "p_value",
            F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("drifted"),
            "reference_mean",
            "new_mean",
            "reference_std",
            "new_std",
            F.lit(None).cast("double").alias("total_variation_distance"),
            F.lit(None).cast("boolean").alias("low_expected_counts"),
        )
    )


def category_counts(reference: DataFrame, new: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of every category on both sides; a missing value is a category."""
    rows = both_sides(reference, new, [*by, *columns], text=True)
    cells = long_values(rows, columns, [F.col(SIDE), *[F.col(quoted(b)) for b in by]])
    return cells.groupBy(*by, "column", "lval", "dval", "sval").agg(
        F.count_if(F.col(SIDE) == 0).alias("ref"), F.count_if(F.col(SIDE) == 1).alias("new")
    )


def contingency_test(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Chi-squared test and total variation distance per ``by`` of rows holding ``ref`` and ``new`` counts.

    One degree of freedom gets the continuity correction; an empty side leaves only "identical or not".
    """
    totals = counts.groupBy(*by).agg(
        F.sum("ref").alias("n_ref"), F.sum("new").alias("n_new"), F.count(F.lit(1)).alias("k")
    )
    both = counts.join(totals, list(by))
    n = F.col("n_ref") + F.col("n_new")
    size = F.col("ref") + F.col("new")

    def part(side: str) -> tuple[Column, Column]:
        expected = F.try_divide(F.col(f"n_{side}") * size, n)
        off = F.abs(expected - F.col(side))
        off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        return F.try_divide(off * off, expected), expected

    (chi_ref, exp_ref), (chi_new, exp_new) = part("ref"), part("new")
    share = F.abs(F.col("ref") / F.greatest("n_ref", F.lit(1)) - F.col("new") / F.greatest("n_new", F.lit(1)))
    found = both.groupBy(*by).agg(
        F.sum(chi_ref + chi_new).alias("chi"),
        F.min(F.least(exp_ref, exp_new)).alias("smallest"),
        (F.sum(share) * 0.5).alias("total_variation_distance"),
        F.max("k").alias("k"),
        F.max("n_ref").alias("n_ref"),
        F.max("n_new").alias("n_new"),
    )
    empty = (F.col("n_ref") == 0) | (F.col("n_new") == 0)
    return (
        found.withColumn("dof", F.col("k") - 1)
        .withColumn(
            "statistic",
            F.when(empty, F.when(F.col("n_ref") == F.col("n_new"), F.lit(0.0)))
            .when(F.col("dof") == 0, F.lit(0.0))
            .otherwise(F.col("chi")),
        )
        .withColumn("low_expected_counts", ~empty & (F.col("smallest") < 5))
    )


def categorical_drift(reference: DataFrame, new: DataFrame, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    none = F.lit(None).cast("double")
    return (
        contingency_test(category_counts(reference, new, columns), ["column"])
        .withColumn(
            "p_value",
            F.when(F.col("statistic").isNotNull(), F.when(F.col("chi").isNull(), F.lit(1.0)).otherwise(chi2_sf("statistic", "dof"))),
        )
        .select(
            "column",
            F.lit("chi-squared").alias("test"),
            "statistic",
            "dof",
            "p_value",
            F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("drifted"),
            none.alias("reference_mean"),
            none.alias("new_mean"),
            none.alias("reference_std"),
            none.alias("new_std"),
            "total_variation_distance",
            "low_expected_counts",
        )
    )


def schema_difference(reference: DataFrame, new: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """Columns only the reference has, and columns only the new table has."""
    lost = [c for c in reference.columns if c != target and c not in new.columns]
    added = [c for c in new.columns if c != target and c not in reference.columns]
    return lost, added


def schema_difference_rows(reference: DataFrame, new: DataFrame, target: str | None = None) -> DataFrame:
    lost, added = schema_difference(reference, new, target)
    return names_as_issues(new, lost, "error", "drift", "column_lost").unionByName(
        names_as_issues(new, added, "warning", "drift", "column_new")
    )


def drift_report(reference: DataFrame, new: DataFrame, target: str | None = None, alpha: float = 0.05) -> DataFrame:
    """One test row per shared feature column."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    rt, nt = field_types(reference), field_types(new)
    shared = [c for c in reference.columns if c in nt and c != target]
    numbers = [c for c in shared if is_numeric(rt[c]) and is_numeric(nt[c])]
    others = [c for c in shared if c not in numbers]
    parts = []
    if numbers:
        parts.append(numeric_drift(reference, new, numbers, alpha).select(*RESULT))
    if others:
        parts.append(categorical_drift(reference, new, others, alpha).select(*RESULT))
    if not parts:
        raise ValueError("the tables share no feature column")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def drift_issues(reference: DataFrame, new: DataFrame, target: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Drift findings plus lost and added columns."""
    tests = drift_report(reference, new, target, alpha)
    number = F.col("test") == "kolmogorov-smirnov"
    c = F.col("column")
    found = issues_from(
        tests,
        [
            F.when(
                F.col("drifted"),
                F.when(number, issue("warning", "drift", c, "numeric_drift", F.col("statistic"))).otherwise(
                    issue("warning", "drift", c, "category_drift", F.col("total_variation_distance"))
                ),
            ),
            F.when(F.col("low_expected_counts"), issue("info", "drift", c, "low_expected", F.lit(None))),
        ],
    )
    lost, added = schema_difference(reference, new, target)
    return found.unionByName(schema_difference_rows(reference, new, target)) if lost or added else found
