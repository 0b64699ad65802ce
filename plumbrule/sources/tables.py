"""Readers, writers, fingerprints and stored models."""

from __future__ import annotations

import json
import platform
from collections.abc import Sequence

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrule.core.frames import quoted, require_columns, with_nulls

SCHEMA_VERSION = 1

# The bundled building table, its feature sets and its label codes.
BUILDING_COLUMNS = (
    ("Building Type", "string"),
    ("Square Footage", "bigint"),
    ("Number of Occupants", "bigint"),
    ("Appliances Used", "bigint"),
    ("Average Temperature", "double"),
    ("Day of Week", "string"),
    ("Energy Consumption", "double"),
)
FEATURE_SETS = {
    "core": ("Energy Consumption", "Square Footage"),
    "extended": ("Energy Consumption", "Square Footage", "Number of Occupants", "Appliances Used"),
    "all": ("Energy Consumption", "Square Footage", "Number of Occupants", "Appliances Used", "Average Temperature"),
}
BUILDING_LABELS = {"Residential": 0, "Commercial": 1, "Industrial": 2}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sampling: float = 1.0) -> DataFrame:
    """CSV with a header; the schema is inferred (from a share of the rows for large files) unless given."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling).csv(path)


def load_raw(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV without the rows that miss any value."""
    return with_nulls(read_csv(spark, path, schema)).dropna("any")


def building_schema() -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in BUILDING_COLUMNS])


def load_features(spark: SparkSession, path: str, feature_set: str = "core", label: str = "Building Type") -> DataFrame:
    """The named feature columns as doubles and the coded label."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set}; choose from {sorted(FEATURE_SETS)}")
    df = load_raw(spark, path, building_schema())
    codes = F.create_map(*[F.lit(x) for pair in BUILDING_LABELS.items() for x in pair])
    return df.select(*[F.col(quoted(c)).cast("double") for c in FEATURE_SETS[feature_set]], F.try_element_at(codes, F.col(quoted(label))).alias("label"))


def building_features(df: DataFrame) -> DataFrame:
    """Raw measurements, weekend flag and three ratios of a building table."""
    from plumbrule.operators.prep import indicator, ratio_features

    named = {
        "Energy Consumption": "energy_consumption",
        "Square Footage": "square_footage",
        "Number of Occupants": "num_occupants",
        "Appliances Used": "appliances_used",
        "Average Temperature": "avg_temperature",
    }
    out = indicator(df, "Day of Week", "Weekend", "is_weekend").withColumnsRenamed(named)
    out = ratio_features(
        out,
        {
            "energy_per_sqft": ("energy_consumption", "square_footage"),
            "occupancy_density": ("num_occupants", "square_footage"),
            "appliance_per_occ": ("appliances_used", "num_occupants"),
        },
    )
    names = [*named.values(), "is_weekend", "energy_per_sqft", "occupancy_density", "appliance_per_occ"]
    return out.select(*[F.col(n).cast("double") for n in names])


def first_rows(df: DataFrame, columns: Sequence[str], order: Sequence[str], count: int = 100) -> DataFrame:
    """The first rows by an explicit order; only the named columns are read."""
    require_columns(df, columns)
    return df.select(*dict.fromkeys([*columns, *order])).orderBy(*map(quoted, order)).limit(count).select(*map(quoted, columns))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def prediction_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*map(quoted, df.columns))).alias("value"))


def append_runs(runs: DataFrame, path: str, run_id: str) -> None:
    """Append ``model, metric, value`` rows to the run log, one folder per run."""
    (
        runs.select("model", "metric", F.col("value").cast("double").alias("value"))
        .withColumn("run_id", F.lit(run_id))
        .withColumn("logged_at", F.current_timestamp())
        .write.mode("append")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes when any row does, whatever the row order: count, xor and sum of row hashes."""
    lines = [F.coalesce(F.regexp_replace(F.col(quoted(n)).cast("string"), "\r\n", "\n"), F.lit("\0")) for n in df.columns]
    h = F.xxhash64(*lines)
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0)).alias("sum_hash"),
        F.lit(names).alias("columns"),
    )


def row_digests(df: DataFrame) -> DataFrame:
    """SHA-256 of every row, with line ends normalised."""
    lines = [F.coalesce(F.regexp_replace(F.col(quoted(n)).cast("string"), "\r\n", "\n"), F.lit("\0")) for n in df.columns]
    return df.select("*", F.sha2(F.concat_ws("\x1f", *lines), 256).alias("digest"))


def metadata(df: DataFrame, models: Sequence[str]) -> dict[str, object]:
    row = fingerprint(df).first().asDict()
    return {
        "schema_version": SCHEMA_VERSION,
        "data": {k: str(v) for k, v in row.items()},
        "versions": {"pyspark": pyspark.__version__, "python": platform.python_version()},
        "models": list(models),
    }


def save_model(model: PipelineModel, path: str, df: DataFrame, models: Sequence[str], classes: Sequence[str]) -> None:
    """Store a fitted pipeline next to a metadata row describing data, versions and model order."""
    model.write().overwrite().save(f"{path}/model")
    meta = {**metadata(df, models), "classes": list(classes)}
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str, df: DataFrame | None = None, models: Sequence[str] | None = None) -> tuple[PipelineModel, dict]:
    """Load a stored pipeline; with ``df`` or ``models`` given, refuse one made from other data or models."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta["schema_version"] != SCHEMA_VERSION:
        raise ValueError("stored model has another schema version")
    if models is not None and list(models) != meta["models"]:
        raise ValueError("stored model covers another ordered list of models")
    if df is not None:
        now = metadata(df, models or meta["models"])
        if now["data"] != meta["data"]:
            raise ValueError("stored model was made from other data")
        if now["versions"] != meta["versions"]:
            raise ValueError("stored model was made with other library versions")
    return PipelineModel.load(f"{path}/model"), meta
