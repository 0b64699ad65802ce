"""Attributions: linear, Shapley values over a small background, local surrogates, and their summaries.

Attributions travel in long form ``id, class, feature, value, shap, lime``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.functions.columns import hashed_normal
from plumbrule.operators.clean import even_sample
from plumbrule.operators.shapley import coalitions

MAX_EXACT = 10
ScoreFn = Callable[[DataFrame], DataFrame]


def linear_attribution(df: DataFrame, key: str, features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """``id, feature, value, shap`` = w * (x - mean of x) for a linear model with independent features."""
    means = df.agg(F.struct(*[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)]).alias("m"))
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(quoted(f)).cast("double").alias("value"),
            (float(w) * (F.col(quoted(f)).cast("double") - F.col(f"_m.m{i}"))).alias("shap"),
        )
        for i, (f, w) in enumerate(zip(features, weights))
    ]
    return df.withColumn("_m", means.scalar()).select(F.col(quoted(key)).alias("id"), F.inline(F.array(*cells)))


def shapley(rows: DataFrame, key: str, features: Sequence[str], background: Sequence[dict], score: ScoreFn, output: str = "score", budget: int | None = None, seed: int = 42) -> DataFrame:
    """Shapley values of ``score`` (a column ``output`` it adds), exact for up to ten features.

    Every row meets every coalition and every background row in one exploded table, which is
    scored once; averages per coalition then combine with the Shapley weights as one grouped sum.
    Beyond ten features the coalitions are those of ``shapley.coalitions``.  Scores that are functions of a
    matrix, and trees, are better served by ``shapley``, which explodes nothing.
    """
    d = len(features)
    if d > MAX_EXACT:
        return _sampled(rows, key, features, background, score, output, budget, seed)
    back = F.array(*[F.struct(*[F.lit(float(b[f])).alias(f"b{i}") for i, f in enumerate(features)]) for b in background])
    base = rows.select(F.col(quoted(key)).alias("id"), *[F.col(quoted(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    wide = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(2**d - 1))).alias("mask")).select("*", F.explode(back).alias("b"))
    mixed = wide.select(
        "id", "mask", *[F.when(F.expr(f"mask & {1 << i}") != 0, F.col(f"x{i}")).otherwise(F.col(f"b.b{i}")).alias(f) for i, f in enumerate(features)]
    )
    value = score(mixed).groupBy("id", "mask").agg(F.avg(output).alias("v"))
    size = F.bit_count("mask")
    cells = []
    for i, f in enumerate(features):
        inside = F.expr(f"mask & {1 << i}") != 0
        table = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
        weight = F.get(F.array(*map(F.lit, table)), F.when(inside, size - 1).otherwise(size))
        cells.append(F.struct(F.lit(f).alias("feature"), (F.when(inside, weight).otherwise(-weight) * F.col("v")).alias("t")))
    found = value.select("id", F.inline(F.array(*cells))).groupBy("id", "feature").agg(F.sum("t").alias("shap"))
    values = base.select("id", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").alias("value")) for i, f in enumerate(features)])))
    return found.join(values, ["id", "feature"]).select("id", "feature", "value", "shap")


def _sampled(rows: DataFrame, key: str, features: Sequence[str], background: Sequence[dict], score: ScoreFn, output: str, budget: int | None, seed: int) -> DataFrame:
    """Attributions as weighted sums of the mean scores of listed coalitions, the empty and the whole one among them."""
    d = len(features)
    plan = coalitions(d, budget, seed)
    masks = np.vstack([plan.masks, np.zeros((1, d), bool), np.ones((1, d), bool)])
    weights = np.column_stack([plan.solve, -plan.solve.sum(axis=1) - plan.spread, plan.spread])
    sums: dict[str, np.ndarray] = {}
    for mask, weight in zip(masks, weights.T):
        name = "".join("01"[int(inside)] for inside in mask)
        sums[name] = sums.get(name, 0) + weight
    back = F.array(*[F.struct(*[F.lit(float(b[f])).alias(f"b{i}") for i, f in enumerate(features)]) for b in background])
    base = rows.select(F.col(quoted(key)).alias("id"), *[F.col(quoted(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    wide = base.select("*", F.explode(F.split(F.lit(",".join(sums)), ",")).alias("mask")).select("*", F.explode(back).alias("b"))
    mixed = wide.select("id", "mask", *[F.when(F.substring("mask", i + 1, 1) == "1", F.col(f"x{i}")).otherwise(F.col(f"b.b{i}")).alias(f) for i, f in enumerate(features)])
    value = score(mixed).groupBy("id", "mask").agg(F.avg(output).alias("v"))
    table = rows.sparkSession.createDataFrame([(m, [float(x) for x in w]) for m, w in sums.items()], "mask string, w array<double>")
    joined = value.join(F.broadcast(table), "mask")  # as many rows as the budget
    found = joined.groupBy("id").agg(F.array(*[F.sum(F.col("w")[i] * F.col("v")) for i in range(d)]).alias("s"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x{i}").alias("value"), F.col("s")[i].alias("shap")) for i, f in enumerate(features)])
    return base.join(found, "id").select("id", F.inline(cells))


def background_rows(df: DataFrame, order: Sequence[str], features: Sequence[str], size: int = 100) -> list[dict]:
    """Evenly spaced rows used as background; ``size`` rows reach the driver."""
    picked = even_sample(df.dropna("any", subset=list(features)), order, size)
    return [r.asDict() for r in picked.select(*map(quoted, features)).collect()]


def explain_globally(df: DataFrame, key: str, features: Sequence[str], score: ScoreFn, rows: int | None = None, background: int = 100, output: str = "score") -> DataFrame:
    """Mean absolute Shapley value per feature over all rows, or over an even sample of ``rows``.

    ``background`` evenly spaced rows stand for the features outside a coalition.
    """
    back = background_rows(df, [key], features, background)
    explained = df if rows is None else even_sample(df, [key], rows)
    return global_importance(shapley(explained, key, features, back, score, output))


def global_importance(attributions: DataFrame, by_class: str | None = None, classes: Sequence | None = None) -> DataFrame:
    """``feature, mean_abs_shap`` (mean over classes), with one column per class when asked."""
    if by_class is None:
        return attributions.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature")
    per = attributions.groupBy("feature", by_class).agg(F.avg(F.abs("shap")).alias("m"))
    wide = per.groupBy("feature").pivot(by_class, list(classes) if classes else None).agg(F.max("m"))
    names = [c for c in wide.columns if c != "feature"]
    total = sum((F.coalesce(F.col(quoted(c)), F.lit(0.0)) for c in names), F.lit(0.0)) / float(len(names))
    return wide.select("feature", total.alias("mean_abs_shap"), *[F.col(quoted(c)).alias(f"mean_abs_shap_{c}") for c in names]).orderBy(F.desc("mean_abs_shap"), "feature")


def lime(rows: DataFrame, key: str, features: Sequence[str], scales: Sequence[float], score: ScoreFn, samples: int = 500, width: float | None = None, seed: int = 42, output: str = "score", alpha: float = 1.0) -> DataFrame:
    """Local ridge surrogates: ``id, feature, lime, intercept, r2``.

    Perturbed copies of each row are scored once, and the weighted sums of products of every row come from
    one grouped aggregate; only the tiny solve per row runs in Python.
    """
    d = len(features)
    width = width or 0.75 * math.sqrt(d)
    base = rows.select(F.col(quoted(key)).alias("id"), *[F.col(quoted(f)).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    made = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("s"))
    made = made.withColumns({f"z{i}": hashed_normal(seed, "id", "s", F.lit(i)) for i in range(d)})
    moved = made.select("id", *[f"z{i}" for i in range(d)], *[(F.col(f"x{i}") + F.col(f"z{i}") * float(scales[i])).alias(f) for i, f in enumerate(features)])
    scored = score(moved)
    gap2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(d)), F.lit(0.0))
    w = F.sqrt(F.exp(-gap2 / (width * width)))
    cols = [F.lit(1.0), *[F.col(f"z{i}") for i in range(d)], F.col(output).cast("double")]
    pairs = list(itertools.combinations_with_replacement(range(d + 2), 2))
    sums = scored.withColumn("_w", w).groupBy("id").agg(F.array(*[F.sum(F.col("_w") * cols[a] * cols[b]) for a, b in pairs]).alias("g"))

    def solve(g: pd.Series) -> pd.Series:
        out = []
        for line in g:
            m = np.zeros((d + 2, d + 2))
            for (a, b), v in zip(pairs, line):
                m[a, b] = m[b, a] = v
            penalty = np.diag([0.0, *[alpha] * d])
            beta = np.linalg.solve(m[: d + 1, : d + 1] + penalty, m[: d + 1, d + 1])
            total = m[d + 1, d + 1] - m[0, d + 1] ** 2 / m[0, 0]
            left = m[d + 1, d + 1] - 2 * beta @ m[: d + 1, d + 1] + beta @ m[: d + 1, : d + 1] @ beta
            out.append([*beta, 1 - left / total if total > 1e-12 else 0.0])
        return pd.Series(out)

    fitted = sums.withColumn("b", F.pandas_udf(solve, "array<double>")("g"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("b")[i + 1].alias("lime")) for i, f in enumerate(features)])
    return fitted.select("id", F.inline(cells), F.col("b")[0].alias("intercept"), F.col("b")[d + 1].alias("r2"))


def compare_attributions(shap: DataFrame, lime_rows: DataFrame) -> DataFrame:
    """Both attributions per row and feature with the agreement of their signs (NULL if one is absent)."""
    both = shap.join(lime_rows, ["id", "feature"], "full_outer")
    agree = F.when(F.col("shap").isNotNull() & F.col("lime").isNotNull(), F.signum("shap") == F.signum("lime"))
    w = Window.partitionBy("id").orderBy(F.desc(F.abs(F.coalesce("shap", "lime"))), "feature")
    return both.withColumn("sign_agreement", agree).withColumn("rank", F.row_number().over(w))


def top_contributors(attributions: DataFrame, strongest: int = 2) -> DataFrame:
    """The strongest features and the weakest one per row; equal sizes go by name."""
    size = F.abs("shap")
    up = Window.partitionBy("id").orderBy(F.desc(size), "feature")
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    ranked = attributions.withColumns({"rank": F.row_number().over(up), "_n": n})
    return ranked.where((F.col("rank") <= strongest) | (F.col("rank") == F.col("_n"))).select(
        "id", "feature", "shap", "rank", F.when(F.col("rank") <= strongest, "strongest").otherwise("weakest").alias("role")
    )


def local_explanation(scored: DataFrame, attributions: DataFrame) -> DataFrame:
    """Predictions with their attributions attached as an array; a row without any keeps its prediction."""
    cells = attributions.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("feature", "value", "shap"))).alias("contributions"))
    return scored.join(cells, "id", "left")
