"""Column kinds, missing values and the long form shared by every per-column operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)
NESTED = (T.ArrayType, T.MapType, T.StructType)


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans count as numbers."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [n for n, t in field_types(df).items() if is_numeric(t) and n not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [n for n, t in field_types(df).items() if not is_numeric(t) and n not in skip]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"unknown column(s): {', '.join(absent)}")


def require_flat(df: DataFrame) -> None:
    nested = [n for n, t in field_types(df).items() if isinstance(t, NESTED)]
    if nested:
        raise TypeError(f"nested columns are not supported here: {', '.join(nested)}")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def value_of(name: str, dtype: T.DataType) -> Column:
    """The column with NaN turned into NULL, so that one test finds every missing value."""
    c = F.col(quoted(name))
    return F.nanvl(c, F.lit(None).cast(dtype)) if isinstance(dtype, FLOATS) else c


def as_double(name: str, dtype: T.DataType) -> Column:
    return value_of(name, dtype).cast("double")


def with_nulls(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in the named (or all) floating columns."""
    wanted = set(names if names is not None else df.columns)
    return df.select(
        *[
            value_of(n, t).alias(n) if n in wanted and isinstance(t, FLOATS) else F.col(quoted(n))
            for n, t in field_types(df).items()
        ]
    )


def _slots(name: str, dtype: T.DataType) -> tuple[Column, Column, Column]:
    """Exact value of a column in one of three typed slots (integral, floating, text)."""
    none_l, none_d, none_s = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    c = value_of(name, dtype)
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return c.cast("bigint"), none_d, none_s
    if isinstance(dtype, FLOATS):
        return none_l, c.cast("double"), none_s
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c), none_d, none_s
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint"), none_d, none_s
    return none_l, none_d, c.cast("string")


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """One row per (row, column): ``column, lval, dval, sval, is_missing`` plus the kept columns.

    Values stay in their own type, so grouping needs no number-to-text conversion.
    """
    types = field_types(df)
    cells = []
    for name in columns:
        lval, dval, sval = _slots(name, types[name])
        cells.append(F.struct(F.lit(name).alias("column"), lval.alias("lval"), dval.alias("dval"), sval.alias("sval")))
    out = df.select(*keep, F.inline(F.array(*cells)))
    empty = F.col("lval").isNull() & F.col("dval").isNull() & F.col("sval").isNull()
    return out.withColumn("is_missing", empty)


def column_rows(df: DataFrame, columns: Sequence[str], measures: dict[str, dict[str, Column]]) -> DataFrame:
    """Aggregate once, then turn the single wide row into one row per column.

    ``measures[name][column]`` is the aggregate called ``name`` of that column.
    """
    aggs = [expr.alias(f"{m}__{i}") for m, per in measures.items() for i, expr in enumerate(per[c] for c in columns)]
    wide = df.agg(*aggs)
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *[F.col(f"{m}__{i}").alias(m) for m in measures])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*cells)))


def rounded(col: Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col, digits) + F.lit(0.0)


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Mark a table for broadcast only when a count proves it small; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
