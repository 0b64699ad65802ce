"""Imputation, scaling, encoding and feature construction.  Fit and apply are separate steps."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import as_double, broadcast_if_small, column_rows, field_types, quoted
from plumbrule.core.ordering import medians
from plumbrule.operators.association import class_codes
from plumbrule.operators.profile import value_counts

MAX_CATEGORIES = 1_000
MAX_VOCABULARY = 100_000


def impute_median(df: DataFrame, columns: Sequence[str], fitted: dict[str, float] | None = None) -> DataFrame:
    """Fill missing numbers with the median of ``fitted`` (default: of this table)."""
    fill = fitted if fitted is not None else medians(df, columns)
    types = field_types(df)
    return df.withColumns({c: F.coalesce(as_double(c, types[c]), F.lit(fill[c])) for c in columns})


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column, the smallest on a tie; one row per column is collected."""
    best = F.min(F.struct((-F.col("n")).alias("k"), "lval", "dval", "sval"))
    rows = value_counts(df, columns).groupBy("column").agg(best.alias("b")).collect()
    return {r["column"]: next((v for v in (r["b"]["lval"], r["b"]["dval"], r["b"]["sval"]) if v is not None), None) for r in rows}


def impute_mode(df: DataFrame, columns: Sequence[str], fitted: dict[str, object] | None = None) -> DataFrame:
    fill = fitted if fitted is not None else modes(df, columns)
    return df.fillna({c: fill[c] for c in columns if fill.get(c) is not None})


def scale_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 when zero) of each column."""
    types = field_types(df)
    x = {c: as_double(c, types[c]) for c in columns}
    rows = column_rows(df, columns, {"m": {c: F.avg(x[c]) for c in columns}, "s": {c: F.stddev_pop(x[c]) for c in columns}}).collect()
    return {r["column"]: (r["m"] or 0.0, r["s"] or 1.0) for r in rows}


def standard_scale(df: DataFrame, columns: Sequence[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    facts = fitted if fitted is not None else scale_facts(df, columns)
    types = field_types(df)
    return df.withColumns({c: (as_double(c, types[c]) - F.lit(facts[c][0])) / F.lit(facts[c][1]) for c in columns})


def unscale(df: DataFrame, column: str, fact: tuple[float, float]) -> DataFrame:
    """Undo :func:`standard_scale` on a predicted target."""
    return df.withColumn(column, F.col(quoted(column)) * fact[1] + fact[0])


def categories(df: DataFrame, column: str) -> list:
    """Sorted distinct values; refuses columns with more than ``MAX_CATEGORIES``."""
    found = df.select(quoted(column)).where(F.col(quoted(column)).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    return sorted(r[0] for r in found)


def token(value: object) -> str:
    """A category as a column-name part."""
    return "".join(ch if ch.isalnum() else "_" for ch in str(value)).strip("_").lower() or "blank"


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """Replace a column by one 0/1 column per category; values not among the categories give all zeros."""
    values = list(values) if values is not None else categories(df, column)
    rest = [c for c in df.columns if c != column]
    flags = [F.coalesce((F.col(quoted(column)) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{token(v)}") for v in values]
    return df.select(*map(quoted, rest), *flags)


def label_encode(df: DataFrame, column: str, output: str = "code") -> DataFrame:
    """Add the 0-based code of the label in text order; missing labels keep a NULL code."""
    codes = broadcast_if_small(class_codes(df, column).withColumnsRenamed({"label": "_label", "code": output}))
    return df.join(codes, F.col(quoted(column)).cast("string") == F.col("_label"), "left").drop("_label")


def label_decode(df: DataFrame, column: str, labels: Sequence[str], output: str = "label") -> DataFrame:
    return df.withColumn(output, F.get(F.array(*map(F.lit, labels)), F.col(column).cast("int")))


def ratio_features(df: DataFrame, ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Add quotients whose denominator is raised to at least 1."""
    return df.withColumns({name: F.col(quoted(a)) / F.greatest(F.col(quoted(b)), F.lit(1)) for name, (a, b) in ratios.items()})


def indicator(df: DataFrame, column: str, value: object, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce((F.col(quoted(column)) == F.lit(value)).cast("double"), F.lit(0.0)))


def poly_features(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """All monomials of degree 1 to ``degree``, named like ``x__y`` and ``x__x``; no constant term."""
    terms = {}
    for d in range(1, degree + 1):
        for combo in itertools.combinations_with_replacement(columns, d):
            product: Column = F.lit(1.0)
            for c in combo:
                product = product * F.col(quoted(c)).cast("double")
            terms["__".join(combo)] = product
    rest = [c for c in df.columns if c not in columns]
    return df.select(*map(quoted, rest), *[e.alias(n) for n, e in terms.items()])


def binarize(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    return df.withColumns({c: (F.col(quoted(c)) > threshold).cast("int") for c in columns})


def fourier_features(df: DataFrame, columns: Sequence[str], components: int = 200, gamma: float = 1.0, seed: int = 42, output: str = "rff") -> DataFrame:
    """Random Fourier features of the radial kernel as an array column (vectorised in Arrow batches)."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=np.sqrt(2 * gamma), size=(len(columns), components))
    shift = rng.uniform(0, 2 * np.pi, size=components)

    def project(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(dtype=float) for p in parts])
        return pd.Series(list(np.sqrt(2.0 / components) * np.cos(x @ weights + shift)))

    fn = F.pandas_udf(project, "array<double>")
    return df.withColumn(output, fn(*[F.col(quoted(c)).cast("double") for c in columns]))


TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(df: DataFrame, column: str, stop_words: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """One row per token of two or more letters, digits or underscores, in lower case."""
    words = F.regexp_extract_all(F.lower(F.col(quoted(column))), F.lit(TOKEN), F.lit(0))
    out = df.select(*map(quoted, keep), F.explode(words).alias("token"))
    return out.where(~F.col("token").isin(*stop_words)) if stop_words else out


def vocabulary(df: DataFrame, column: str, stop_words: Sequence[str] = (), size: int = 5000) -> DataFrame:
    """The ``size`` most frequent tokens (ties by token) with their total counts."""
    return (
        tokens(df, column, stop_words)
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(size)
    )


def token_matrix(df: DataFrame, column: str, key: str, stop_words: Sequence[str] = (), size: int = 5000) -> DataFrame:
    """Sparse bag of words: ``key, token, n`` for tokens of the vocabulary."""
    words = vocabulary(df, column, stop_words, size).select("token")
    if size <= MAX_VOCABULARY:
        words = F.broadcast(words)  # at most ``size`` rows by construction
    return tokens(df, column, stop_words, [key]).join(words, "token").groupBy(quoted(key), "token").agg(F.count(F.lit(1)).alias("n"))
