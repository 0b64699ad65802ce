"""Leaderboard diagnostics and report facts.  Inputs are small result tables (one row per model or feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted

# Model-name parts per complexity level, in order of precedence.
COMPLEXITY = (
    ("Very low", ("dummy",)),
    ("Low", ("logistic", "ridge")),
    ("Medium", ("knn", "svm", "svr")),
    ("High", ("forest", "extra", "boost", "xgboost", "hist")),
    ("High", ("mlp", "neural")),
)
CV_NAMES = ("cv_accuracy", "cv_r2", "CV Mean", "cv_mean")
TEST_NAMES = ("test_accuracy", "test_r2", "Test Acc", "test_score")
MODEL_NAMES = ("model", "Model", "name")
SCORE_NAMES = ("feature_importance", "importance", "quality_score")


def _first_of(df: DataFrame, names: Sequence[str], dtype: str) -> Column:
    found = [F.col(quoted(n)).cast(dtype) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(dtype)


def normalize_results(results: DataFrame) -> DataFrame:
    """``model, cv_score, test_score`` from a leaderboard with any of the known column names."""
    return results.select(
        _first_of(results, MODEL_NAMES, "string").alias("model"),
        _first_of(results, CV_NAMES, "double").alias("cv_score"),
        _first_of(results, TEST_NAMES, "double").alias("test_score"),
    )


def best_by_cv(results: DataFrame) -> DataFrame:
    """The row with the highest cross-validation score (first name on a tie)."""
    return normalize_results(results).where(F.col("cv_score").isNotNull()).orderBy(F.desc("cv_score"), "model").limit(1)


def feature_scores(ranking: DataFrame) -> DataFrame:
    """``feature, importance, mutual_information``; importance falls back to mutual information."""
    mi = _first_of(ranking, ("mutual_information",), "double")
    return ranking.select("feature", F.coalesce(_first_of(ranking, SCORE_NAMES, "double"), mi).alias("importance"), mi.alias("mutual_information"))


def model_diagnostics(results: DataFrame, cv: str = "cv_accuracy", test: str = "test_accuracy", secondary: str = "test_f1_macro") -> DataFrame:
    """Rank, gaps and near-best flag per model."""
    whole = Window.partitionBy()
    best = F.max(test).over(whole)
    return results.select(
        F.row_number().over(Window.orderBy(F.desc(test), "model")).alias("rank"),
        "model",
        F.col(test).alias("test_metric"),
        F.col(cv).alias("cv_metric"),
        (F.col(cv) - F.col(test)).alias("cv_test_gap"),
        (best - F.col(test)).alias("gap_from_best"),
        F.col(secondary).alias("secondary_metric"),
        (F.abs(best - F.col(test)) <= 0.01).alias("near_best"),
    )


def model_complexity(results: DataFrame) -> DataFrame:
    name = F.lower("model")
    level: Column | None = None
    for label, parts in COMPLEXITY:
        hit = F.lit(False)
        for p in parts:
            hit = hit | name.contains(p)
        level = F.when(hit, label) if level is None else level.when(hit, label)
    return results.select("model", level.otherwise("Medium").alias("complexity"))


def overfit_verdict(diagnostics: DataFrame) -> DataFrame:
    """Verdict on the best model's gap, and whether several models are suspiciously perfect."""
    gap = F.col("cv_test_gap")
    verdict = (
        F.when(gap > 0.10, "overfitting warning")
        .when(gap < -0.10, "unusually easy or small test split")
        .when(F.abs(gap) <= 0.05, "no strong signal")
        .otherwise("moderate gap")
    )
    near = F.sum(F.col("near_best").cast("long")).over(Window.partitionBy())
    return (
        diagnostics.withColumn("near_best_models", near)
        .where(F.col("rank") == 1)
        .select(
            "model",
            "cv_test_gap",
            verdict.alias("verdict"),
            ((F.col("test_metric") >= 0.98) & (F.col("near_best_models") > 1)).alias("near_perfect"),
        )
    )


def compare_feature_sets(full: DataFrame, compact: DataFrame, test: str = "test_accuracy", secondary: str = "test_f1_macro") -> DataFrame:
    """Best model of each leaderboard, their difference, and the two warnings drawn from it."""

    def best(df: DataFrame, name: str) -> DataFrame:
        top = df.orderBy(F.desc(test), "model").limit(1)
        return top.select(F.lit(name).alias("feature_set"), F.col("model").alias("best_model"), F.col(test).alias("primary_metric"), F.col(secondary).alias("secondary_metric"))

    both = best(full, "all").unionByName(best(compact, "compact"))
    whole = Window.partitionBy()
    of = lambda s: F.max(F.when(F.col("feature_set") == s, F.col("primary_metric"))).over(whole)
    return (
        both.withColumn("gap", of("all") - of("compact"))
        .withColumn("large_gap", F.col("gap") >= 0.15)
        .withColumn("suspicious", (of("all") >= 0.98) & F.col("large_gap"))
    )


def importance_comparison(attributions: DataFrame, native: DataFrame) -> DataFrame:
    """Two importance tables matched by feature name."""
    return attributions.join(native, "feature", "full_outer").orderBy(F.desc_nulls_last("mean_abs_shap"), "feature")


def report_facts(profile_row: DataFrame, results: DataFrame, ranking: DataFrame, compact: DataFrame | None = None, top: int = 5) -> DataFrame:
    """One row: table counts, best models, strongest features, and what is missing for a report."""
    best = best_by_cv(results).select(F.struct(F.col("model"), F.col("cv_score"), F.col("test_score")).alias("b"))
    names = ranking.orderBy(F.desc("mutual_information"), "feature").limit(top)
    listed = names.agg(F.sort_array(F.collect_list(F.struct((-F.col("mutual_information")).alias("k"), "feature"))).alias("s"))
    models = results.agg(F.count(F.lit(1)))
    out = profile_row.withColumns(
        {
            "_b": best.scalar(),
            "n_models": models.scalar(),
            "_s": listed.scalar(),
        }
    )
    out = out.withColumn("top_features", F.transform("_s", lambda s: s["feature"])).drop("_s")
    if compact is not None:
        small = best_by_cv(compact).select(F.struct(F.col("model"), F.col("test_score")).alias("b"))
        out = out.withColumn("_c", small.scalar()).withColumns({"compact_model": F.col("_c.model"), "compact_test_score": F.col("_c.test_score")}).drop("_c")
    out = out.withColumns({"best_model": F.col("_b.model"), "best_cv_score": F.col("_b.cv_score"), "best_test_score": F.col("_b.test_score")}).drop("_b")
    errors = F.array_compact(F.array(F.when(F.col("n_models") == 0, "no model result"), F.when(F.col("n_rows") == 0, "no rows")))
    warnings = F.array_compact(F.array(F.when(F.size("top_features") == 0, "no feature importance")))
    return out.withColumns({"errors": errors, "warnings": warnings})


def mesh_grid(df: DataFrame, x: str, y: str, step_x: float, step_y: float, pad: float = 1.0) -> DataFrame:
    """Points of a rectangular grid around the data, for drawing a model's decision surface."""
    edge = df.agg(
        (F.min(x) - pad).alias("x0"), (F.max(x) + pad).alias("x1"), (F.min(y) - pad).alias("y0"), (F.max(y) + pad).alias("y1")
    )

    def steps(lo: str, hi: str, step: float) -> Column:
        return F.sequence(F.lit(0), (F.ceil((F.col(hi) - F.col(lo)) / step) - 1).cast("int"))

    return (
        edge.withColumn("i", F.explode(steps("x0", "x1", step_x)))
        .repartition("i")
        .withColumn("j", F.explode(steps("y0", "y1", step_y)))
        .select((F.col("x0") + F.col("i") * step_x).alias(x), (F.col("y0") + F.col("j") * step_y).alias(y))
    )


def dataset_computation(df: DataFrame, target: str, features: Sequence[str], results: DataFrame | None, compact: DataFrame | None = None) -> dict[str, DataFrame]:
    """The named diagnostic tables that can be built from what is at hand; all lazy but the rankings."""
    from plumbrule.operators.association import feature_diagnostics, target_associations

    out = {"feature_diagnostics": feature_diagnostics(df, target, features), "target_associations": target_associations(df, target, features)}
    if results is None:
        out["readiness"] = df.sparkSession.range(1).select(F.lit("no model results yet").alias("message"))
        return out
    out["model_diagnostics"] = model_diagnostics(results)
    out["model_complexity"] = model_complexity(results)
    if compact is not None:
        out["feature_sets"] = compare_feature_sets(results, compact)
    return out
