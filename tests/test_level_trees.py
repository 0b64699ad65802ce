"""Extremely randomised trees and histogram boosting against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plumbrule.operators import level_trees
from plumbrule.operators.level_trees import ExtraTrees, HistogramBoosting


def frame(spark, x, y):
    df = spark.createDataFrame([(i, list(map(float, r)), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, x array<double>, _label double")
    return df.withColumn("_features", array_to_vector("x"))


def predictions(df):
    return np.array([r["prediction"] for r in df.orderBy("id").select("id", "prediction").collect()])


@pytest.fixture(scope="module")
def classed():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (400, 5)), 2)
    x[:, 4] = 3.0
    return x, (x[:, 0] > 0.2).astype(int) + (x[:, 1] * x[:, 2] > 0)


def plain_extra(x, y, t, depth, wanted, classes, seed):
    """One tree grown with the same hashes; returns the outputs of the training rows."""
    pick, draw = level_trees.hashed_share(seed), level_trees.hashed_share(seed + 1)
    out = np.zeros((len(x), classes or 1))

    def impurity(v):
        return len(v) - sum((v == c).sum() ** 2 for c in range(classes)) / len(v) if classes else ((v - v.mean()) ** 2).sum()

    def grow(rows, node, level):
        v = y[rows]
        out[rows] = [(v == c).mean() for c in range(classes)] if classes else v.mean()
        able = [f for f in range(x.shape[1]) if x[rows, f].min() < x[rows, f].max()]
        if level == depth or len(rows) < 2 or impurity(v) <= 1e-12 * len(rows) or not able:
            return
        order = sorted(able, key=lambda f: pick(t, node, f)[0])[:wanted]
        best = None
        for f in order:
            low, high = x[rows, f].min(), x[rows, f].max()
            cut = low + draw(t, node, f)[0] * (high - low)
            left = x[rows, f] <= (low if cut >= high else cut)
            gain = impurity(v) - impurity(v[left]) - impurity(v[~left])
            if best is None or gain > best[0] + 1e-9:
                best = (gain, left)
        grow(rows[best[1]], 2 * node + 1, level + 1)
        grow(rows[~best[1]], 2 * node + 2, level + 1)

    grow(np.arange(len(x)), 0, 0)
    return out


@pytest.mark.parametrize("cells", [400_000, 40])
def test_extra_trees_equal_a_plain_version(spark, classed, monkeypatch, cells):
    monkeypatch.setattr(level_trees, "CELLS", cells)
    x, y = classed
    df = frame(spark, x, y)
    trees = 2 if cells == 40 else 4
    model = ExtraTrees(trees=trees, depth=3, seed=5).fit(df.repartition(3))
    want = sum(plain_extra(x, y, t, 3, 2, 3, 5) for t in range(trees)) / trees
    assert np.allclose(model.trees.total(x) / trees, want)
    assert (predictions(model.transform(df)) == want.argmax(axis=1)).all()


def test_extra_trees_of_a_number(spark, classed):
    x, _ = classed
    y = 3 * x[:, 0] + np.abs(x[:, 1])
    df = frame(spark, x, y)
    model = ExtraTrees("regression", trees=3, depth=4, seed=9).fit(df)
    want = sum(plain_extra(x, y, t, 4, 5, 0, 9) for t in range(3))[:, 0] / 3
    assert np.allclose(predictions(model.transform(df)), want)


def test_deep_extra_trees_know_their_rows(spark, classed):
    x, y = classed
    df = frame(spark, x, y)
    assert (predictions(ExtraTrees(trees=10, depth=12).fit(df).transform(df)) == y).mean() > 0.97


def test_one_class_constant_features_and_no_rows(spark):
    flat = frame(spark, np.ones((10, 2)), np.arange(10) % 2)
    assert (ExtraTrees(trees=2).fit(flat).trees.feature == -1).all()
    one = frame(spark, np.arange(20).reshape(10, 2), np.zeros(10))
    assert (predictions(ExtraTrees(trees=2).fit(one).transform(one)) == 0).all()
    for learner in (ExtraTrees(), HistogramBoosting()):
        with pytest.raises(ValueError):
            learner.fit(flat.limit(0))
    boosted = HistogramBoosting(rounds=3, least=1).fit(flat)
    assert not boosted.splits() and predictions(boosted.transform(flat)).tolist() == [0.0] * 10
    assert boosted.transform(flat.limit(0)).collect() == []


def plain_boost(x, y, classes, rounds, rate, depth, least):
    """Exact boosting over all values; margins after every round."""
    k = classes if classes > 2 else 1
    p0 = np.array([(y == c).mean() for c in range(max(classes, 1))])
    f = np.tile(np.log(p0) if classes > 2 else [np.log(p0[1] / p0[0])] if classes else [y.mean()], (len(x), 1))
    losses = []
    for _ in range(rounds):
        if classes > 2:
            p = np.exp(f) / np.exp(f).sum(1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(classes)), p * (1 - p)
            losses.append(-np.log(p[np.arange(len(y)), y.astype(int)]).mean())
        elif classes:
            p = 1 / (1 + np.exp(-f))
            g, h = p - y[:, None], p * (1 - p)
            losses.append((np.logaddexp(0, f[:, 0]) - y * f[:, 0]).mean())
        else:
            g, h = f - y[:, None], np.ones_like(f)
            losses.append(0.5 * ((f[:, 0] - y) ** 2).mean())
        step = np.zeros_like(f)
        for c in range(k):
            def grow(rows, level):
                step[rows, c] = -rate * g[rows, c].sum() / h[rows, c].sum()
                best = None
                if level < depth:
                    for j in range(x.shape[1]):
                        for cut in np.unique(x[rows, j])[:-1]:
                            left = x[rows, j] <= cut
                            if min(left.sum(), (~left).sum()) < least:
                                continue
                            score = lambda m: g[rows[m], c].sum() ** 2 / h[rows[m], c].sum()  # noqa: B023, E731
                            gain = score(left) + score(~left) - score(left | True)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, left)
                if best:
                    grow(rows[best[1]], level + 1)
                    grow(rows[~best[1]], level + 1)

            grow(np.arange(len(x)), 0)
        f = f + step
    return f, losses


@pytest.mark.parametrize("classes", [3, 2, 0])
def test_boosting_equals_a_plain_version(spark, classes):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (250, 3)).astype(float)
    score = x[:, 0] - x[:, 1] + 4 * (x[:, 2] > 6) + rng.normal(0, 2, 250)
    y = np.digitize(score, np.quantile(score, [0.3, 0.7] if classes == 3 else [0.6])).astype(float) if classes else score
    df = frame(spark, x, y)
    learner = HistogramBoosting("classification" if classes else "regression", rounds=4, rate=0.3, depth=2, least=10, cut=2)
    model = learner.fit(df.repartition(3))
    want, losses = plain_boost(x, y, classes, 4, 0.3, 2, 10)
    assert np.allclose(model.margins(x), want, atol=1e-8)
    assert np.allclose(learner.losses, losses) and all(a > b for a, b in zip(learner.losses, learner.losses[1:]))
    got = predictions(model.transform(df))
    assert np.allclose(got, want[:, 0]) if not classes else (got == (want.argmax(1) if classes > 2 else want[:, 0] > 0)).all()


def test_many_values_share_bins(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (600, 2))
    y = (x[:, 0] + 0.2 * x[:, 1] > 0).astype(float)
    df = frame(spark, x, y)
    model = HistogramBoosting(rounds=8, rate=0.3, depth=3, bins=16, least=5).fit(df)
    assert max(map(len, model.edges)) <= 15
    assert (predictions(model.transform(df)) == y).mean() > 0.93
    assert model.transform(df).where(F.col("probability").isNull()).isEmpty()


def test_boosted_median_of_trees(spark):
    from plumbrule.operators.ensembles import BoostedMedian

    rng = np.random.default_rng(8)
    x = rng.uniform(0, 6, (300, 2))
    y = np.sin(x[:, 0]) * 5 + x[:, 1]
    df = frame(spark, x, y)
    fit = BoostedMedian(rounds=6, depth=3).fit(df)
    members = np.array([[r["prediction"] for r in m.transform(df).orderBy("id").select("id", "prediction").collect()] for m in fit.models])
    # the rounds again, in plain arrays
    w = np.ones(300)
    for values, alpha, error in zip(members, fit.alphas, fit.errors):
        e = np.abs(values - y) / np.abs(values - y).max()
        assert error == pytest.approx((w * e).sum() / w.sum()) and error < 0.5
        assert alpha == pytest.approx(np.log((1 - error) / error))
        w = w * (error / (1 - error)) ** (1 - e)
    got = predictions(fit.transform(df))
    for i in range(300):
        order = np.argsort(members[:, i], kind="stable")
        reach = np.cumsum(np.array(fit.alphas)[order])
        assert got[i] == pytest.approx(members[order[np.argmax(reach >= reach[-1] / 2 - 1e-12)], i])
    assert np.abs(got - y).mean() < np.abs(members[0] - y).mean()


def test_boosted_median_ends_early(spark):
    from plumbrule.operators.ensembles import BoostedMedian

    step = frame(spark, np.arange(40).reshape(-1, 1), (np.arange(40) > 19) * 3.0)
    fit = BoostedMedian(rounds=5).fit(step)
    assert len(fit.models) == 1 and fit.errors == [0.0]
    assert predictions(fit.transform(step)).tolist() == [0.0] * 20 + [3.0] * 20


def test_new_families_on_the_leaderboard(spark):
    from plumbrule.operators import model_zoo

    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), "ab"[i % 2], "hi" if a + 0.3 * (i % 2) > 0.2 else "mid" if b > 0 else "lo", float(2 * a + b)) for i, (a, b) in enumerate(rng.normal(0, 1, (150, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, t string, y string, z double")
    names = ["Dummy", "KNN", "Extra Trees", "Histogram Boosting", "AdaBoost"]
    for target, task, main in (("y", "classification", "cv_accuracy"), ("z", "regression", "cv_r2")):
        board = {r["model"]: r[main] for r in model_zoo.leaderboard(model_zoo.prepare_dataset(df, target, ["a", "b", "t"], task, ["id"]), names, k=2, trees=12).collect()}
        assert set(board) == set(names)
        assert all(board[n] > board["Dummy"] + 0.15 for n in names if n != "Dummy")
