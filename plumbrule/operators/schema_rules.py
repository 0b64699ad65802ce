"""Schema rules as one pass over the column statistics, and views of the resulting issue table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.operators.profile import column_stats, duplicate_rows

SEVERITIES = ("error", "warning", "info")
CATEGORIES = ("schema", "leakage", "drift")

# rule -> (what was found, what to do about it)
TEXTS = {
    "empty_table": ("The table has no rows.", "Load a table with at least 30 usable rows."),
    "few_rows": ("The table has fewer than 30 rows, so estimates will be unstable.", "Add representative rows."),
    "few_columns": ("A feature and a target column are needed.", "Use a table with two or more columns."),
    "target_absent": ("The chosen target is not a column of the table.", "Pick an existing column as target."),
    "mostly_missing": ("Over half of the values are missing.", "Leave the column out or impute it with a reason."),
    "many_missing": ("At least a tenth of the values are missing.", "Look at the pattern and impute."),
    "some_missing": ("At least one value in a hundred is missing.", None),
    "single_class": ("The target has fewer than two classes.", "Choose a target with two or more classes."),
    "constant": ("All values are equal.", "Leave the column out of the features."),
    "low_cardinality": ("There are fewer than three distinct values.", "Check that so few values are intended."),
    "identifier_like": ("Over half of the text values are distinct.", "Check whether the column identifies rows."),
    "extreme_value": ("A value lies over ten standard deviations from the mean.", "Check the value for an entry error."),
    "numeric_target": ("The numeric target has over 20 distinct values.", "Check whether this is a regression task."),
    "duplicate_rows": ("Some rows are exact copies of others.", "Remove or explain the copies before training."),
    "required_absent": ("A column needed by the model is absent.", "Supply it under the name used in training."),
    "column_lost": ("A reference column is absent from the new table.", "Restore the column or retrain."),
    "column_new": ("A column is absent from the reference table.", "Decide whether the model should use it."),
    "numeric_drift": ("The distribution of the numbers has moved.", "Find the cause; retrain if it is real."),
    "category_drift": ("The category shares have moved.", "Find the cause; retrain if it is real."),
    "low_expected": ("Some expected counts are below 5, so the test is weak.", "Get more rows or merge rare values."),
    "leak_extreme": ("The feature all but determines the target.", "Leave it out unless known before the outcome."),
    "leak_very_strong": ("The feature is very strongly tied to the target.", "Check when it becomes known."),
    "leak_strong": ("The feature is strongly tied to the target.", "Check for a proxy of the target."),
}


def issue(severity: str, category: str, column: Column, rule: str, measured: Column) -> Column:
    text, advice = TEXTS[rule]
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        column.cast("string").alias("column"),
        F.lit(rule).alias("rule"),
        measured.cast("double").alias("measured"),
        F.lit(text).alias("message"),
        F.lit(advice).cast("string").alias("suggestion"),
    )


def issues_from(rows: DataFrame, candidates: Sequence[Column]) -> DataFrame:
    """Explode the issues that fired on each row; a candidate is an issue struct or NULL."""
    return rows.select(F.inline(F.array_compact(F.array(*candidates))))


def column_issues(stats: DataFrame, target: str | None) -> DataFrame:
    rows, distinct, rate = F.col("n_rows"), F.col("distinct_values"), F.col("missing_pct")
    is_target = F.col("column") == F.lit(target) if target else F.lit(False)

    def found(severity, rule, measured):
        return issue(severity, "schema", F.col("column"), rule, measured)

    below = F.col("low") < F.col("mean") - 10 * F.col("std")
    above = F.col("high") > F.col("mean") + 10 * F.col("std")
    spread = F.col("is_number") & (F.col("present") >= 2) & (F.col("std") > 0) & (F.col("std") < float("inf"))
    return issues_from(
        stats,
        [
            F.when(rate > 0.50, found("error", "mostly_missing", rate))
            .when(rate >= 0.10, found("warning", "many_missing", rate))
            .when(rate >= 0.01, found("info", "some_missing", rate)),
            F.when((rows > 0) & is_target & (distinct <= 1), found("error", "single_class", distinct))
            .when(distinct == 1, found("warning", "constant", distinct))
            .when((distinct < 3) & (rows > 20), found("info", "low_cardinality", distinct)),
            F.when(F.col("is_text") & (rows > 0) & (distinct > 0.5 * rows), found("warning", "identifier_like", distinct)),
            F.when(spread & below, found("warning", "extreme_value", F.col("low"))).when(
                spread & above, found("warning", "extreme_value", F.col("high"))
            ),
            F.when(is_target & F.col("is_number") & (distinct > 20), found("info", "numeric_target", distinct)),
        ],
    )


def table_issues(copies: DataFrame, names: Sequence[str], target: str | None) -> DataFrame:
    rows, none, nowhere = F.col("n_rows"), F.lit(None), F.lit(None)

    def found(severity, rule, measured, column=nowhere):
        return issue(severity, "schema", column, rule, measured)

    absent = target is not None and target not in names
    return issues_from(
        copies,
        [
            F.when(rows == 0, found("error", "empty_table", rows)).when(rows < 30, found("warning", "few_rows", rows)),
            F.when(F.lit(len(names) < 2), found("error", "few_columns", F.lit(len(names)))),
            F.when(F.lit(absent), found("error", "target_absent", none, F.lit(target))),
            F.when(F.col("duplicate_rows") > 0, found("warning", "duplicate_rows", F.col("duplicate_rows"))),
        ],
    )


def schema_issues(df: DataFrame, target: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """All schema findings of the table."""
    stats = stats if stats is not None else column_stats(df)
    return table_issues(duplicate_rows(df), df.columns, target).unionByName(column_issues(stats, target))


def coverage_issues(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One error per required column that the table lacks."""
    return names_as_issues(df, [c for c in required if c not in df.columns], "error", "schema", "required_absent")


def names_as_issues(df: DataFrame, names: Sequence[str], severity: str, category: str, rule: str) -> DataFrame:
    one = df.sparkSession.range(1)
    return issues_from(one, [issue(severity, category, F.lit(n), rule, F.lit(None)) for n in names] or
                       [F.when(F.lit(False), issue(severity, category, F.lit(None), rule, F.lit(None)))])


def sorted_issues(issues: DataFrame) -> DataFrame:
    """Worst first, then schema before leakage before drift, then by column."""
    rank = lambda col, order: F.array_position(F.array(*map(F.lit, order)), F.col(col))
    return issues.orderBy(rank("severity", SEVERITIES), rank("category", CATEGORIES), F.coalesce("column", F.lit("")), "rule")


def issue_summary(issues: DataFrame) -> DataFrame:
    """One row: findings per severity, whether the table passed, and a sentence."""
    per = [F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES]
    sentence = F.when(
        F.col("errors") + F.col("warnings") + F.col("infos") == 0, F.lit("no findings")
    ).otherwise(F.concat_ws(", ", *[F.concat_ws(" ", F.col(f"{s}s").cast("string"), F.lit(s)) for s in SEVERITIES]))
    return issues.agg(*per).select("*", (F.col("errors") == 0).alias("passed"), sentence.alias("summary"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Counts per severity and category with subtotals."""
    return (
        issues.rollup("severity", "category")
        .agg(F.count(F.lit(1)).alias("findings"), F.grouping_id().cast("int").alias("level"))
    )
