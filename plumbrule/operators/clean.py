"""Row and column cleaning, row constraints and deterministic row picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import field_types, quoted, require_columns, value_of, with_nulls
from plumbrule.core.ordering import medians, ordered_index
from plumbrule.functions.columns import hashed_normal


def clean_dataframe(df: DataFrame) -> DataFrame:
    """Drop rows with no value at all, then columns with no value at all."""
    types = field_types(df)
    kept = df.where(F.coalesce(*[value_of(n, t).cast("string") for n, t in types.items()]).isNotNull())
    row = kept.agg(*[F.count(value_of(n, t)).alias(f"c{i}") for i, (n, t) in enumerate(types.items())]).first()
    return kept.select(*[F.col(f"`{n}`") for i, n in enumerate(types) if row[f"c{i}"] > 0])


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows in which all named (default: all) columns have a value."""
    names = list(columns or df.columns)
    require_columns(df, names)
    return df.dropna("any", subset=names)


def excluded_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows :func:`drop_incomplete` keeps and drops, in one pass."""
    require_columns(df, columns)
    types = field_types(df)
    complete = F.lit(True)
    for c in columns:
        complete = complete & value_of(c, types[c]).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(complete).alias("rows_after"),
        F.count_if(~complete).alias("rows_excluded"),
    )


def check_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons`` (names of the violated rules, in rule order) and ``valid``.

    A rule that evaluates to NULL counts as violated.
    """
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*named))).withColumn("valid", F.size("reasons") == 0)


def even_sample(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``size`` rows at evenly spaced positions of the ordered table (all rows if there are fewer)."""
    placed = ordered_index(df, order, name="_idx", total="_n")
    last, steps = F.col("_n") - 1, max(size - 1, 1)
    # position i is chosen iff it equals trunc(j * (n-1) / (size-1)) for the smallest j that reaches it
    j = F.ceil(F.col("_idx") * steps / F.greatest(last, F.lit(1)))
    chosen = F.floor(j * last / steps) == F.col("_idx")
    if size == 1:
        chosen = F.col("_idx") == 0
    return placed.where((F.col("_n") <= size) | chosen).drop("_idx", "_n")


def median_binarize(df: DataFrame, columns: Sequence[str], fitted: dict[str, float] | None = None) -> DataFrame:
    """Replace each column by 1 if it is above its (training) median, else 0."""
    cut = fitted or medians(df, columns)
    return df.withColumns({c: (F.col(c) > F.lit(cut[c])).cast("int") for c in columns})


def add_noise(df: DataFrame, columns: Sequence[str], sigma: float, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Add normal noise to the columns, drawn from the row's ``key`` (default: all its values), so the same on every cluster."""
    names = [quoted(c) for c in key or df.columns]
    return df.withColumns({c: F.col(quoted(c)) + hashed_normal(seed, F.lit(i), *names) * sigma for i, c in enumerate(columns)})


def complete_rows(df: DataFrame) -> DataFrame:
    return with_nulls(df).dropna("any")
