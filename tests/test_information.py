"""Nearest-neighbour information of numbers with classes and with other numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrule.operators import association


def psi(n):
    return -0.57721566490153286 + sum(1 / j for j in range(1, n))


def plane(x, y, k=3):
    """Both axes scaled; points at distance 0 are compared as discrete values."""
    x, y = (np.asarray(a, float) / (np.std(a) or 1.0) for a in (x, y))
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    n, total = len(x), 0.0
    k = min(k, n - 1)
    for i in range(n):
        d = np.maximum(dx[i], dy[i])
        r = np.sort(np.delete(d, i))[k - 1]
        if r > 0:
            total += psi(k) - psi((dx[i] < r * (1 - 1e-9)).sum()) - psi((dy[i] < r * (1 - 1e-9)).sum())
        else:
            total += psi((d == 0).sum()) - psi((dx[i] == 0).sum()) - psi((dy[i] == 0).sum())
    return max(0.0, psi(n) + total / n)


def information(df, target, features, **options):
    return {r["feature"]: r["mutual_information"] for r in association.feature_information(df, target, features, **options).collect()}


def test_numbers_with_a_numeric_target(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(0, 1, 150)
    columns = {"close": y + rng.normal(0, 0.1, 150), "noise": rng.uniform(0, 1, 150), "steps": np.floor(y), "flat": np.ones(150), "copy": y * -3 + 7}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, *columns.values())], "y double, " + ", ".join(f"{c} double" for c in columns))
    got = information(df, "y", list(columns), task="regression")
    assert got == {c: pytest.approx(plane(x, y), abs=1e-6) for c, x in columns.items()}
    assert got["copy"] > got["close"] > got["steps"] > got["noise"] and got["flat"] == pytest.approx(0.0, abs=0.02)


def test_ties_on_both_axes(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), rng.randrange(3)) for _ in range(300)]
    rows = [(a, b if a else 9) for a, b in rows] + [(7, 50)]
    df = spark.createDataFrame(rows, "x int, y int")
    assert information(df, "y", ["x"], task="regression")["x"] == pytest.approx(plane(*zip(*rows)), abs=1e-6)


def test_missing_numbers_and_texts(spark):
    rows = [(float(i % 13), None if i % 4 == 0 else float(i % 5), None if i % 3 == 0 else "ab"[i % 2], None if i == 5 else float(i % 13) * 2) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, t string, y double")
    kept = [r for r in rows if r[3] is not None]
    middle = float(np.median([r[1] for r in kept if r[1] is not None]))
    got = information(df, "y", ["a", "b", "t"], task="regression")
    assert got["a"] == pytest.approx(plane([r[0] for r in kept], [r[3] for r in kept]), abs=1e-6)
    assert got["b"] == pytest.approx(plane([middle if r[1] is None else r[1] for r in kept], [r[3] for r in kept]), abs=1e-6)
    assert 0 <= got["t"] < 0.5


def test_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "x double, y double")
    assert information(df, "y", ["x"], task="regression")["x"] == pytest.approx(plane([1, 2], [2, 4]), abs=1e-6)
    assert information(df.limit(0), "y", ["x"], task="regression") == {}
    assert information(df, "y", [], task="regression") == {}


def test_number_that_determines_forty_classes_is_a_leak(spark):
    df = spark.createDataFrame([(float((i * 7) % 40) + 0.001 * (i % 3), f"c{i % 40}", float(i * 37 % 101)) for i in range(2000)], "x double, g string, other double")
    scores = {r["column"]: r["score"] for r in association.leakage_scores(df, "g", "classification").collect()}
    assert scores["x"] > 0.95 and scores["other"] < 0.3
    assert [(r["column"], r["severity"]) for r in association.leakage_issues(df, "g", "classification").collect()] == [("x", "error")]
    binned = {r["column"]: r["score"] for r in association.leakage_scores(df, "g", "classification", bins=10).collect()}
    assert binned["x"] < 0.7


def test_classes_of_one_row_are_left_out(spark):
    rows = [(float(i), "ab"[i // 30]) for i in range(60)]
    alone = [(0.5, "only"), (29.5, "once")]
    with_, without = (association.nearest_information(spark.createDataFrame(r, "x double, g string"), "g", ["x"]).first()["mutual_information"] for r in (rows + alone, rows))
    assert with_ == pytest.approx(without)


def test_ranking_by_task(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(0, 1, (2, 400))
    df = spark.createDataFrame([(float(a), float(b), float(np.sin(3 * a))) for a, b in zip(x, z)], "x double, z double, y double")
    ranked = association.rank_features(df, "y", ["z", "x"], None, "regression").collect()
    assert [r["feature"] for r in ranked] == ["x", "z"] and ranked[0]["mutual_information"] > 1 > 0.2 > ranked[1]["mutual_information"]
    assert association.rank_features(df, "y", ["z", "x"], 1, "regression").count() == 1
    told = association.recommend_features(df, "y", ["z", "x"], task="regression").collect()
    assert {r["feature"]: r["recommendation"] for r in told} == {"x": "Strong", "z": "Weak"}


def test_blocks_of_the_plane_grow_with_the_root_of_the_points(spark, monkeypatch):
    """A point is held against all blocks, so their number may not grow with the points; blocks do not change the result."""
    asked, search = [], association.nearest
    monkeypatch.setattr(association, "nearest", lambda *a, **o: (asked.append(o["block_rows"]), search(*a, **o))[1])
    df = spark.range(400).select(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("y"), F.sqrt(F.col("id") + 1.0).alias("x"))
    found = [association.pair_information(df, "y", ["x"], block_rows=n).first()["mutual_information"] for n in (4, 1000)]
    points = df.distinct().count()
    assert asked == [math.isqrt(points // 2), 1000] and abs(found[0] - found[1]) < 1e-9
