"""The distributed order against a single-partition window, with skewed and tied keys."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbrule.core.ordering import (
    cut_points,
    exact_quantiles,
    medians,
    neighbour_chunks,
    ordered_index,
    running_sums,
    stacked_running,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, 5.0 if rng.random() < 0.4 else float(rng.randint(0, 300)), "hot" if rng.random() < 0.5 else f"g{rng.randint(0, 9)}") for i in range(4000)]
    return spark.createDataFrame(rows, "id long, x double, g string").repartition(7).cache()


def test_index_equals_window(skewed):
    got = ordered_index(skewed, ["x", "id"], name="at", total="n")
    want = skewed.withColumn("want", F.row_number().over(Window.orderBy("x", "id")) - 1)
    assert got.join(want, "id").where("at != want OR n != 4000").isEmpty()


def test_index_within_hot_group(skewed):
    got = ordered_index(skewed, ["x", "id"], by=["g"], name="at")
    want = skewed.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")) - 1)
    assert got.count() == 4000
    assert got.join(want, "id").where("at != want").isEmpty()


def test_hot_value_is_spread(skewed):
    from plumbrule.core.ordering import PART, RANGE, _ranged

    sizes = _ranged(skewed, ["x", "id"], 16, True).groupBy(RANGE, PART).count()
    assert sizes.agg(F.max("count")).first()[0] < 4000 * 0.2


def test_text_order(spark):
    rows = [(f"k{i:04d}",) for i in range(500)]
    df = spark.createDataFrame(rows[::-1], "k string")
    got = ordered_index(df, ["k"], name="at")
    assert got.where(F.concat(F.lit("k"), F.lpad(F.col("at").cast("string"), 4, "0")) != F.col("k")).isEmpty()


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, x int")
    assert sorted(r["at"] for r in ordered_index(df, ["x"], by=["g"], name="at").collect()) == [0, 0, 1]


def test_running_sums(skewed):
    per = skewed.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = running_sums(per, "x", ["n"])
    want = per.withColumn("want", F.sum("n").over(Window.orderBy("x")))
    assert got.join(want, "x").where("cum_n != want OR total_n != 4000").isEmpty()


def test_stacked_running_descending(skewed):
    got = stacked_running(skewed, ["x"], {"n": F.lit(1)}, descending=True)
    want = skewed.groupBy("x").count().withColumn("want", F.sum("count").over(Window.orderBy(F.desc("x"))))
    assert got.join(want, got["value"] == want["x"]).where("cum_n != want").isEmpty()


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 0.9, 1.0]])
def test_quantiles_match_numpy(skewed, probs):
    x = np.array([r["x"] for r in skewed.select("x").collect()])
    row = exact_quantiles(skewed, ["x"], probs).first()
    assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(x, probs).tolist())


def test_quantiles_of_a_table_too_long_for_its_brackets(skewed, monkeypatch):
    from plumbrule.core import ordering

    monkeypatch.setattr(ordering, "BRACKET_ROWS", 100)
    df = skewed.select((F.col("x") + F.col("id") / 4000).alias("u"), "x")
    u = np.array([r["u"] for r in df.select("u").collect()])
    probs = [0.0, 0.1, 0.33, 0.5, 0.98, 1.0]
    stats = ordering.order_statistics(df, ["u", "x"], lambda n, _: ordering.quantile_ranks(n, probs), grid=20)
    got = [ordering.interpolate(4000, p, stats["u"][1].__getitem__) for p in probs]
    assert got == pytest.approx(np.quantile(u, probs).tolist())


def test_median_ignores_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,)], "x double")
    assert medians(df, ["x"]) == {"x": 2.5}


def test_empty_table_has_no_cuts(spark):
    df = spark.createDataFrame([], "x double")
    assert cut_points(df, ["x"]) == {"x": []}
    assert ordered_index(df, ["x"]).count() == 0


@pytest.mark.parametrize("before,after", [(0, 4), (3, 0), (2, 3)])
def test_chunks_see_their_neighbours(spark, before, after):
    df = spark.range(97).select(F.lit("one").alias("g"), F.col("id").alias("x"))
    chunks, w = neighbour_chunks(df, ["x"], ["g"], before, after, size=10)
    got = chunks.withColumn("lo", F.lag("x", before).over(w) if before else F.col("x")).withColumn("hi", F.lead("x", after).over(w) if after else F.col("x")).where("_own")
    assert got.count() == 97
    lo = F.when(F.col("x") >= before, F.col("x") - before)
    hi = F.when(F.col("x") + after < 97, F.col("x") + after)
    assert got.where(~F.col("lo").eqNullSafe(lo) | ~F.col("hi").eqNullSafe(hi)).isEmpty()
    assert chunks.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 10 + before + after
