"""Structured Streaming forms of scoring and drift monitoring.

The batch and streaming forms share their counting code: a window's category counts and value counts are
merged over micro-batches and tested against a reference table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbrule.core.frames import quoted
from plumbrule.functions.significance import chi2_sf
from plumbrule.operators.drift import contingency_test
from plumbrule.operators.scoring import score_batch


def windowed_counts(events: DataFrame, ts: str, category: str, width: str = "1 day", watermark: str | None = None) -> DataFrame:
    """Rows per event-time window and category; works on tables and streams."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    return (
        rows.groupBy(F.window(ts, width).alias("w"), F.coalesce(F.col(quoted(category)).cast("string"), F.lit("<MISSING>")).alias("category"))
        .agg(F.count(F.lit(1)).alias("new"))
        .select(F.col("w.start").alias("window_start"), "category", "new")
    )


def drift_by_window(reference: DataFrame, counts: DataFrame, category: str) -> DataFrame:
    """Chi-squared and total variation distance of each window's categories against the reference.

    Both tables are already one row per category (and window), so the union stays small.
    """
    ref = reference.groupBy(F.coalesce(F.col(quoted(category)).cast("string"), F.lit("<MISSING>")).alias("category")).agg(F.count(F.lit(1)).alias("ref"))
    windows = counts.select("window_start").distinct()
    listed = ref.agg(F.collect_list(F.struct("category", "ref")).alias("l"))
    full = windows.withColumn("l", listed.scalar()).select("window_start", F.inline("l")).withColumn("new", F.lit(0).cast("long"))
    seen = counts.select("window_start", "category", F.lit(0).cast("long").alias("ref"), "new")
    merged = full.unionByName(seen).groupBy("window_start", "category").agg(F.sum("ref").alias("ref"), F.sum("new").alias("new"))
    tested = contingency_test(merged, ["window_start"])
    p = F.when(F.col("statistic").isNotNull(), chi2_sf("statistic", "dof"))
    return tested.withColumn("p_value", p).select(
        "window_start", "statistic", "dof", "p_value", F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("drifted"), "total_variation_distance", "low_expected_counts"
    )


def monitor_stream(stream: DataFrame, reference: DataFrame, ts: str, category: str, sink: Callable[[DataFrame, int], None], checkpoint: str, width: str = "1 day", watermark: str = "1 hour") -> StreamingQuery:
    """Test each closed window against the reference and hand the result rows to ``sink``.

    Append mode emits a window once, after the watermark has passed it, so late rows inside the watermark
    are counted and a restart repeats no window.
    """
    counts = windowed_counts(stream, ts, category, width, watermark)

    def each(batch: DataFrame, epoch: int) -> None:
        sink(drift_by_window(reference, batch, category), epoch)

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def score_stream(stream: DataFrame, model: PipelineModel, classes: Sequence[str], keep: Sequence[str], rules: dict[str, Column], good_path: str, bad_path: str, checkpoint: str) -> StreamingQuery:
    """Score arriving rows; rows that break a rule go to the quarantine folder with their reasons."""
    from plumbrule.operators.clean import check_rows

    checked = check_rows(stream, rules)

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.persist()
        try:
            # a folder per epoch: repeating an epoch after a failure overwrites its own output only
            score_batch(rows.where("valid"), model, classes, keep).write.mode("overwrite").parquet(f"{good_path}/epoch={epoch}")
            rows.where(~F.col("valid")).select(*keep, "reasons").write.mode("overwrite").parquet(f"{bad_path}/epoch={epoch}")
        finally:
            rows.unpersist()

    return checked.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
