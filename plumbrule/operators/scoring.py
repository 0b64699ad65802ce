"""Scoring tables and streams with fitted pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.functions.columns import prediction
from plumbrule.operators.clean import check_rows


def score_batch(df: DataFrame, model: PipelineModel, classes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Class and probability map per row; the same code serves tables and streams."""
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    record = prediction("_p", classes)
    return out.select(*keep, record["class"].alias("class"), record["probabilities"].alias("probabilities"))


def score_checked(df: DataFrame, model: PipelineModel, classes: Sequence[str], keep: Sequence[str], rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(scored valid rows, rejected rows with their reasons)."""
    checked = check_rows(df, rules)
    good = checked.where("valid").drop("valid", "reasons")
    return score_batch(good, model, classes, keep), checked.where(~F.col("valid")).select(*keep, "reasons")


def with_explanations(scored: DataFrame, explanations: DataFrame | None, key: str) -> DataFrame:
    """Predictions always survive; explanations are attached where there are any."""
    if explanations is None:
        return scored.withColumn("contributions", F.lit(None).cast("array<struct<feature:string,shap:double>>"))
    cells = explanations.groupBy(F.col("id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("feature", "shap"))).alias("contributions"))
    return scored.join(cells, key, "left")
