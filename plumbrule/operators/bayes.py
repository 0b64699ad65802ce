"""Naive Bayes models as grouped sufficient statistics and joined or literal parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbrule.core.frames import as_double, field_types, quoted
from plumbrule.functions.columns import log_sum_exp

MAX_CLASSES = 1_000
LOG_2PI = math.log(2 * math.pi)


def _few(per_class: DataFrame) -> list:
    rows = per_class.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return rows


def _scored(df: DataFrame, classes: list, logs: list[Column]) -> DataFrame:
    """Add ``prediction`` (first best class), ``probabilities`` and ``log_evidence``."""
    out = df.withColumn("_l", F.array(*logs)).withColumn("log_evidence", log_sum_exp("_l"))
    return out.withColumns(
        {
            "prediction": F.get(F.array(*map(F.lit, classes)), (F.array_position("_l", F.array_max("_l")) - 1).cast("int")),
            "probabilities": F.transform("_l", lambda v: F.exp(v - F.col("log_evidence"))),
        }
    ).drop("_l")


def gaussian_nb(train: DataFrame, label: str, features: Sequence[str], smoothing: float = 1e-9) -> tuple[list, dict]:
    """Priors, means and smoothed variances per class (as many numbers as classes times features)."""
    types = field_types(train)
    x = [as_double(c, types[c]) for c in features]
    rows = _few(
        train.groupBy(F.col(quoted(label)).alias("g")).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
            *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)],
        )
    )
    rows = sorted((r for r in rows if r["g"] is not None), key=lambda r: r["g"])
    n = sum(r["n"] for r in rows)
    d = len(x)
    # the overall variance of all cells of the matrix follows from the group moments
    mean = sum(r["n"] * r[f"m{i}"] for r in rows for i in range(d)) / (n * d)
    whole = sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in rows for i in range(d)) / (n * d)
    extra = smoothing * max(whole, 1.0)
    fit = {r["g"]: (r["n"] / n, [r[f"m{i}"] for i in range(d)], [r[f"v{i}"] + extra for i in range(d)]) for r in rows}
    return list(fit), fit


def score_gaussian(df: DataFrame, fit: tuple[list, dict], features: Sequence[str]) -> DataFrame:
    classes, params = fit
    types = field_types(df)
    logs = []
    for g in classes:
        prior, means, variances = params[g]
        log = F.lit(math.log(prior + 1e-12))
        for c, m, v in zip(features, means, variances):
            gap = as_double(c, types[c]) - m
            log = log - 0.5 * (F.lit(LOG_2PI + math.log(v)) + gap * gap / v)
        logs.append(log)
    return _scored(df, classes, logs)


def multinomial_nb(counts: DataFrame, label: str, alpha: float = 1.0) -> DataFrame:
    """Log probability per class and token from a long bag of words ``label, token, n``.

    Every (class, vocabulary token) pair gets a row, smoothed when unseen: the vocabulary is spread over
    an array of the few classes, so no table-sized product of two tables is formed.
    """
    negative = F.count_if(F.col("n") < 0)
    total = F.col("n_class") + alpha * F.col("size")
    seen = counts.groupBy("token", F.col(quoted(label)).alias("label")).agg(F.sum("n").alias("n"), negative.alias("bad"))
    seen = seen.withColumn("n", F.when(F.col("bad") > 0, F.raise_error(F.lit("counts must not be negative"))).otherwise(F.col("n"))).drop("bad")
    per_class = seen.groupBy("label").agg(F.sum("n").alias("n_class"))
    classes = per_class.agg(F.collect_list(F.struct("label", "n_class")).alias("c"))
    vocabulary = seen.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
    size = vocabulary.agg(F.count(F.lit(1)).alias("size"))
    return (
        vocabulary.withColumn("c", classes.scalar())
        .withColumn("size", size.scalar())
        .select("token", "m", "size", F.inline("c"))
        .select("label", "token", F.ln((F.coalesce(F.try_element_at("m", F.col("label")), F.lit(0)) + alpha) / total).alias("log_prob"))
    )


def class_log_priors(df: DataFrame, label: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)))
    return df.groupBy(F.col(quoted(label)).alias("label")).agg(F.count(F.lit(1)).alias("n")).select("label", F.ln(F.col("n") / total.scalar()).alias("log_prior"))


def score_multinomial(tokens: DataFrame, key: str, log_probs: DataFrame, priors: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Best class per document of a long bag of words ``key, token, n`` (smallest label on a tie).

    Documents without a known token get the class with the largest prior; ``docs`` names all documents, if
    some may have no token at all.
    A document's class sums are aggregated before anything is compared, and a frequent token only adds
    rows to a map-side sum.
    """
    per_token = log_probs.groupBy("token").agg(F.collect_list(F.struct("label", "log_prob")).alias("p"))
    sums = (
        tokens.join(per_token, "token")
        .select(quoted(key), "n", F.inline("p"))
        .groupBy(quoted(key), "label")
        .agg(F.sum(F.col("n") * F.col("log_prob")).alias("s"))
    )
    scored = sums.join(priors, "label").withColumn("s", F.col("s") + F.col("log_prior"))
    best = F.min(F.struct((-F.col("s")).alias("k"), "label"))
    found = scored.groupBy(quoted(key)).agg(best.alias("b")).select(quoted(key), F.col("b.label").alias("prediction"), (-F.col("b.k")).alias("log_score"))
    usual = priors.agg(F.min(F.struct((-F.col("log_prior")).alias("k"), "label")).alias("u")).scalar()
    every = (tokens if docs is None else docs).select(quoted(key)).distinct().join(found, key, "left").withColumn("u", usual)
    return every.select(quoted(key), F.coalesce("prediction", "u.label").alias("prediction"), F.coalesce("log_score", -F.col("u.k")).alias("log_score"))


def top_words(log_probs: DataFrame, count: int = 15) -> DataFrame:
    """The most probable tokens per class."""
    w = Window.partitionBy("label").orderBy(F.desc("log_prob"), "token")
    return log_probs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def bernoulli_nb(train: DataFrame, label: str, features: Sequence[str], alpha: float = 1.0, threshold: float = 0.0) -> tuple[list, dict]:
    types = field_types(train)
    hits = [F.sum((as_double(c, types[c]) > threshold).cast("long")).alias(f"p{i}") for i, c in enumerate(features)]
    rows = _few(train.groupBy(F.col(quoted(label)).alias("g")).agg(F.count(F.lit(1)).alias("n"), *hits))
    rows = sorted((r for r in rows if r["g"] is not None), key=lambda r: r["g"])
    n = sum(r["n"] for r in rows)
    clip = lambda p: min(max(p, 1e-12), 1 - 1e-12)
    fit = {r["g"]: (math.log(r["n"] / n), [clip((r[f"p{i}"] + alpha) / (r["n"] + 2 * alpha)) for i in range(len(features))]) for r in rows}
    return list(fit), fit


def score_bernoulli(df: DataFrame, fit: tuple[list, dict], features: Sequence[str], threshold: float = 0.0) -> DataFrame:
    classes, params = fit
    types = field_types(df)
    logs = []
    for g in classes:
        log = F.lit(params[g][0])
        for c, p in zip(features, params[g][1]):
            log = log + F.when(as_double(c, types[c]) > threshold, math.log(p)).otherwise(math.log(1 - p))
        logs.append(log)
    return _scored(df, classes, logs)


def dummy_class(train: DataFrame, label: str) -> object:
    """Most frequent class, the smallest on a tie."""
    counts = train.where(F.col(quoted(label)).isNotNull()).groupBy(F.col(quoted(label)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("k"), "g"))["g"]).first()[0]


def dummy_baseline(df: DataFrame, label: str) -> DataFrame:
    """One row: the majority class and the accuracy of always predicting it."""
    counts = df.where(F.col(quoted(label)).isNotNull()).groupBy(F.col(quoted(label)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("k"), "g"))["g"].alias("prediction"), (F.max("n") / F.sum("n")).alias("accuracy"))
