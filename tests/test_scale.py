"""Plans and kernels that must hold on tables far larger than a test's."""

from __future__ import annotations

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrule.operators import association, clusters, lloyd, metrics, model_zoo, neighbours


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_shuffled_feature_is_never_broadcast(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    score = lambda d: d.withColumn("prediction", (F.col("a") > 3).cast("int"))
    out = metrics.permutation_importance(df, ["a"], ["id"], score, F.avg((F.col("prediction") == F.col("y")).cast("double")), repeats=3)
    joins = [line for line in plan_of(out).splitlines() if "Join" in line and "_at" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert out.count() == 1


def brute(q, p):
    gap = q[:, None, :] - p[None, :, :]
    return np.sqrt((gap * gap).sum(2))


@pytest.mark.parametrize("width", [2, 8, 9, 64])
def test_distances_of_close_and_far_rows(width):
    rng = np.random.default_rng(width)
    q = rng.normal(1000, 1, (150, width))
    p = np.concatenate([q[:40], q[40:60] + 1e-7, rng.normal(1000, 1, (90, width)), rng.normal(-5, 1, (30, width))])
    got, want = neighbours.euclidean(q, p), brute(q, p)
    assert (got[np.arange(40), np.arange(40)] == 0).all()
    assert np.allclose(got, want, rtol=1e-9, atol=0)


def test_no_cube_of_gaps_is_built(monkeypatch):
    monkeypatch.setattr(neighbours, "_by_differences", None)
    assert neighbours.euclidean(np.eye(64), np.zeros((1, 64))).tolist() == [[1.0]] * 64


def test_rows_that_no_bound_spares_travel_seldom(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WIDE_ROWS", 150)
    rng = np.random.default_rng(3)
    v, label, met = rng.normal(0, 1, (700, 32)), rng.integers(0, 3, 700), []
    meet = neighbours._meet
    monkeypatch.setattr(neighbours, "_meet", lambda visits, points, *rest: met.append(points.select("block").distinct().count()) or meet(visits, points, *rest))
    df = spark.createDataFrame([(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label))], "id long, v array<double>, label int")
    d = brute(v, v)
    w = np.exp(-d)
    np.fill_diagonal(w, 0)
    np.fill_diagonal(d, np.inf)
    best = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest(df, df, 3, True, 10).collect()}
    assert [[best[i, r] for r in (1, 2, 3)] for i in range(700)] == np.argsort(d, axis=1, kind="stable")[:, :3].tolist()
    assert len(met) == 3 and met[-1] < met[0] / 2
    sums = np.stack([w[:, label == k].sum(1) for k in range(3)], axis=1)
    got = {(r["id"], r["label"]): r["p"] for r in neighbours.kernel_vote(df, df, 1.0, True, 10).collect()}
    assert np.allclose([[got[i, k] for k in range(3)] for i in range(700)], sums / (sums.sum(1, keepdims=True) + 1e-12))
    assert met[-1] < met[0] / 2


def test_silhouettes_of_many_labellings_share_their_distances(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in (0, 3, 6)])
    v = np.concatenate([v, v[:25], [[40.0] * 3]])
    models = [v[[0, 70]], v[[0, 70, 130]], v[[0, 70, 130, 205]]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    calls = []
    tile = neighbours._tile_sums
    monkeypatch.setattr(neighbours, "_tile_sums", lambda starts: calls.append(list(starts)) or tile(starts))
    got = neighbours.mean_silhouettes(lloyd.many_labelled(df, models), [len(m) for m in models], 50)
    want = [neighbours.silhouette(lloyd.labelled(df, m)).agg(F.avg("silhouette")).first()[0] for m in models]
    assert np.allclose(got, want, rtol=1e-9) and calls == [[0, 2, 5, 9]]
    table = df.select("id", *[F.col("v")[i].alias(c) for i, c in enumerate("abc")])
    sweep = {r["k"]: r["silhouette"] for r in clusters.cluster_analysis(table, list("abc"), "id", 4, 2).collect()}
    assert len(sweep) == 3 and len(calls) == 2


def test_numbers_need_no_contingency_table(spark, monkeypatch):
    rows = [(i, float(i % 5), float(i % 97), i * 2.0 + 1, "abc"[i % 3], float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, few double, more double, copy double, text string, y double")
    asked, pairs = [], association.pair_counts
    monkeypatch.setattr(association, "pair_counts", lambda d, names, target: asked.extend(names) or pairs(d, names, target))
    scores = {r["column"]: r["score"] for r in association.leakage_scores(df, "y", "regression").collect()}
    assert scores["copy"] == scores["k"] == 1.0 and scores["few"] < 0.1 and asked == []
    scores = {r["column"]: r["score"] for r in association.leakage_scores(df.select("few", "more", "text", F.ascii("text").alias("code")), "text", "classification").collect()}
    assert scores["code"] == 1.0 and scores["few"] < 0.1 and asked == ["code"]


def test_folds_are_kept_on_disk_in_small_partitions(spark, monkeypatch):
    """What every fit reads again takes no memory of the executors, and no partition grows with the table."""
    monkeypatch.setattr(model_zoo, "TASK_ROWS", 100)
    df = spark.range(0, 2000, 1, 2).select("id", (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("b"), (F.col("id") % 50 + F.col("id") % 3).cast("double").alias("y"))
    data, seen = model_zoo.prepare_dataset(df, "y", ["a", "b"], "regression", ["id"]), []

    class Watched(model_zoo.Majority):
        def fit(self, rows):
            parts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
            seen.append((rows.storageLevel.useMemory, rows.storageLevel.useDisk, max(parts), sum(parts)))
            return super().fit(rows)

    monkeypatch.setattr(model_zoo, "regressors", lambda *_: {"Dummy": Watched("regression")})
    board = model_zoo.leaderboard(data, ["Dummy"], k=3).first()
    assert board["cv_mae"] > 0 and len(seen) == 4
    assert all(not memory and disk and most <= 120 for memory, disk, most, _ in seen)
    assert sum(n for *_, n in seen[:3]) == 2 * seen[3][3] and 1500 < seen[3][3] < 1700
