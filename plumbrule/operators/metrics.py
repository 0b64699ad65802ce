"""Evaluation of predictions and scores, all from grouped counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.core.moments import moments
from plumbrule.core.ordering import spread_index, stacked_running
from plumbrule.operators.split import MIX, hash_order


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*map(quoted, by), F.col(quoted(actual)).alias("actual"), F.col(quoted(predicted)).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _class_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True positives, false positives and false negatives per class, without a join."""
    hit = F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("long")

    def part(cls, tp, fp, fn):
        return F.struct(F.col(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    n = F.col("n")
    parts = F.when(hit, F.array(part("actual", n, zero, zero))).otherwise(
        F.array(part("actual", zero, zero, n), part("predicted", zero, n, zero))
    )
    return (
        counts.select(*by, F.inline(parts))
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )


def class_report(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class (zero denominators give 0)."""
    per = _class_counts(confusion_counts(df, actual, predicted, by), by)
    return per.select(
        *by,
        "class",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro-averaged precision, recall and F1."""
    per = _class_counts(confusion_counts(df, actual, predicted, by), by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.groupBy(*by).agg(
        (F.sum(tp) / F.sum(tp + fn)).alias("accuracy"),
        F.avg(ratio(tp, tp + fp)).alias("precision_macro"),
        F.avg(ratio(tp, tp + fn)).alias("recall_macro"),
        F.avg(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_macro"),
        F.sum(tp + fn).alias("n"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE and R2 (0 for a constant target)."""
    y, e = F.col(quoted(actual)), F.col(quoted(actual)) - F.col(quoted(predicted))
    facts = df.groupBy(*map(quoted, by)).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("v"), F.count(y).alias("n")
    )
    return facts.select(
        *map(quoted, by),
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).otherwise(0.0).alias("r2"),
        "n",
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts for every pair of classes, zeros included."""
    counts = confusion_counts(df, actual, predicted)
    classes = counts.agg(F.array_distinct(F.flatten(F.array(F.collect_set("actual"), F.collect_set("predicted")))).alias("c"))
    grid = classes.select(F.explode("c").alias("actual"), "c").select("actual", F.explode("c").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, subset=["n"])


def score_steps(df: DataFrame, score: str, positive: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores from high to low with running counts of positives and negatives."""
    hit = (F.col(positive) if isinstance(positive, str) else positive).cast("long")
    return stacked_running(df, [score], {"pos": hit, "neg": 1 - hit}, by, descending=True).drop("column")


def roc_curve(df: DataFrame, score: str, positive: str | Column, by: Sequence[str] = ()) -> DataFrame:
    steps = score_steps(df, score, positive, by)
    return steps.select(
        *by,
        F.col("value").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )


def roc_auc(df: DataFrame, score: str, positive: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    steps = score_steps(df, score, positive, by)
    slab = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    return steps.groupBy(*by).agg(
        ratio(F.sum(slab), F.max("total_pos").cast("double") * F.max("total_neg")).alias("auc"),
        F.max("total_pos").alias("n_pos"),
        F.max("total_neg").alias("n_neg"),
    )


def pr_curve(df: DataFrame, score: str, positive: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall when everything scoring at least the threshold is called positive."""
    steps = score_steps(df, score, positive, by)
    return steps.select(
        *by,
        F.col("value").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
        ratio(F.col("pos"), F.col("total_pos")).alias("recall_step"),
    )


def average_precision(df: DataFrame, score: str, positive: str | Column, by: Sequence[str] = ()) -> DataFrame:
    return pr_curve(df, score, positive, by).groupBy(*by).agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


def threshold_sweep(df: DataFrame, score: str, positive: str | Column, by: Sequence[str] = ()) -> DataFrame:
    p, r = F.col("precision"), F.col("recall")
    return pr_curve(df, score, positive, by).drop("recall_step").withColumn("f1", ratio(2 * p * r, p + r))


def calibration_curve(df: DataFrame, score: str, positive: str | Column, bins: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and share of positives per uniform bin; an inner edge belongs to the bin below it."""
    edges = F.array(*[F.lit(float(e)) for e in np.linspace(0, 1, bins + 1)[1:-1]])
    s = F.col(quoted(score)).cast("double")
    hit = (F.col(positive) if isinstance(positive, str) else positive).cast("double")
    return (
        df.select(*map(quoted, by), s.alias("s"), hit.alias("hit"))
        .withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("s"))))
        .groupBy(*map(quoted, by), "bin")
        .agg(F.avg("s").alias("mean_predicted"), F.avg("hit").alias("fraction_positive"), F.count(F.lit(1)).alias("n"))
    )


def one_vs_rest(df: DataFrame, actual: str, scores: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form of class scores: ``class, score, is_class``; feed it to the curves with ``by=["class"]``."""
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(quoted(s)).cast("double").alias("score")) for c, s in scores.items()])
    return df.select(*map(quoted, keep), F.col(quoted(actual)).alias("_y"), F.inline(cells)).withColumn("is_class", F.col("_y") == F.col("class")).drop("_y")


def ensemble_diversity(df: DataFrame, actual: str, models: Sequence[str]) -> DataFrame:
    """Q statistic, double fault and disagreement per pair of prediction columns, in one pass and without a self-join."""
    pairs = list(combinations(models, 2))
    ok = {m: F.col(quoted(m)) == F.col(quoted(actual)) for m in models}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (a, b) in enumerate(pairs):
        aggs += [
            F.count_if(ok[a] & ok[b]).alias(f"n11_{i}"),
            F.count_if(~ok[a] & ~ok[b]).alias(f"n00_{i}"),
            F.count_if(ok[a] & ~ok[b]).alias(f"n10_{i}"),
            F.count_if(~ok[a] & ok[b]).alias(f"n01_{i}"),
            F.count_if(F.col(quoted(a)) != F.col(quoted(b))).alias(f"dis_{i}"),
        ]
    cells = [
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), *[F.col(f"{k}_{i}").cast("double").alias(k) for k in ("n11", "n00", "n10", "n01", "dis")])
        for i, (a, b) in enumerate(pairs)
    ]
    same, cross = F.col("n11") * F.col("n00"), F.col("n01") * F.col("n10")
    return df.agg(*aggs).select("n", F.inline(F.array(*cells))).select(
        "model_a",
        "model_b",
        ratio(same - cross, same + cross).alias("q_statistic"),
        (F.col("n00") / F.col("n")).alias("double_fault"),
        (F.col("dis") / F.col("n")).alias("disagreement"),
    )


def diversity_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("q_statistic", "double_fault", "disagreement")])


def error_correlation(df: DataFrame, actual: str, models: Sequence[str]) -> DataFrame:
    """Pearson correlation of the error flags of every pair of models."""
    flags = df.select(*[(F.col(quoted(m)) != F.col(quoted(actual))).cast("double").alias(m) for m in models])
    m = moments(flags, list(models))
    sd = np.sqrt(np.diag(m.scatter))
    rows = []
    for i, a in enumerate(models):
        for j, b in enumerate(models):
            r = m.scatter[i, j] / (sd[i] * sd[j]) if sd[i] * sd[j] > 0 else None
            rows.append((a, b, None if r is None else float(r)))
    return df.sparkSession.createDataFrame(rows, "model_a string, model_b string, correlation double")


def majority(columns: Sequence[str], classes: Sequence) -> Column:
    """Most frequent value of the prediction columns; the smallest class wins a tie."""
    votes = F.array(*[sum(((F.col(quoted(c)) == F.lit(k)).cast("int") for c in columns), F.lit(0)) for k in classes])
    return F.get(F.array(*map(F.lit, classes)), (F.array_position(votes, F.array_max(votes)) - 1).cast("int"))


def greedy_selection(df: DataFrame, actual: str, models: Sequence[str], classes: Sequence | None = None) -> DataFrame:
    """Add, one by one, the model whose vote raises accuracy most; each step is one aggregate."""
    classes = sorted(classes if classes is not None else [r[0] for r in df.select(quoted(actual)).distinct().collect()])
    chosen, rest, steps = [], list(models), []
    while rest:
        row = df.agg(*[F.avg((majority([*chosen, m], classes) == F.col(quoted(actual))).cast("double")).alias(f"a{i}") for i, m in enumerate(rest)]).first()
        best = max(range(len(rest)), key=lambda i: (row[f"a{i}"], -i))
        chosen.append(rest.pop(best))
        steps.append((len(chosen), chosen[-1], float(row[f"a{best}"])))
    return df.sparkSession.createDataFrame(steps, "step int, added_model string, ensemble_accuracy double")


def cv_summary(runs: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    return runs.groupBy(model).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("low"), F.max(score).alias("high"), F.count(score).alias("folds")
    )


def permutation_importance(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    score_fn: Callable[[DataFrame], DataFrame],
    metric: Column,
    repeats: int = 30,
    seed: int = 42,
) -> DataFrame:
    """Mean and deviation of the metric's drop when one feature is shuffled.

    ``score_fn`` adds predictions; ``metric`` is an aggregate over its output.  A shuffle is a join of
    two orders of the same rows: the plain hashed one and one hashed with the repeat number.
    """
    base = score_fn(df).agg(metric.alias("m")).first()["m"]
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_rep"))
    left, spread = hash_order(rows, key, seed)
    left = spread_index(left, [MIX, *key], spread, by=["_rep"], name="_at").drop(MIX)
    right, spread = hash_order(rows, ["_rep", *key], seed + 1)
    right = spread_index(right, [MIX, *key], spread, by=["_rep"], name="_at").drop(MIX)
    parts = []
    for f in features:
        donor = right.select("_rep", "_at", F.col(quoted(f)).alias("_new"))
        # Spark's size estimate does not see that every row stands ``repeats`` times, so no side may be sent whole
        mixed = left.drop(f).join(donor.hint("merge"), ["_rep", "_at"]).withColumnRenamed("_new", f)
        parts.append(score_fn(mixed).groupBy("_rep").agg(metric.alias("m")).select(F.lit(f).alias("feature"), "m"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("feature").agg(F.avg(F.lit(base) - F.col("m")).alias("mean_drop"), F.stddev_pop(F.lit(base) - F.col("m")).alias("std_drop"))
