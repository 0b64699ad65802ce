"""Shapley values by sampled coalitions and by tree paths against their definition."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from plumbrule.operators import explain, shapley


def defined(x, back, score):
    """Shapley values from all coalitions."""
    d = len(x)
    v = {}
    for mask in itertools.product([False, True], repeat=d):
        v[mask] = score(np.where(mask, x[None, :], back)).mean()
    out = np.zeros(d)
    for mask, value in v.items():
        s = sum(mask)
        for i in range(d):
            out[i] += value * (math.factorial(s - 1) * math.factorial(d - s) if mask[i] else -math.factorial(s) * math.factorial(d - s - 1)) / math.factorial(d)
    return out


def curved(x):
    return x[:, 0] * x[:, 1] + np.sin(x[:, 2]) * x[:, 3] ** 2 - x[:, 4]


def frame(spark, x):
    names = [f"f{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)), names


def matrix(df, names):
    rows = {(r["id"], r["feature"]): r["shap"] for r in df.collect()}
    return np.array([[rows[i, f] for f in names] for i in sorted({k for k, _ in rows})], float)


def dicts(back, names):
    return [dict(zip(names, map(float, b))) for b in back]


def test_all_coalitions_give_the_definition(spark):
    rng = np.random.default_rng(1)
    x, back = rng.normal(0, 1, (6, 5)), rng.normal(0, 1, (7, 5))
    df, names = frame(spark, x)
    got = matrix(shapley.kernel_shapley(df, "id", names, dicts(back, names), curved), names)
    assert np.allclose(got, [defined(r, back, curved) for r in x])


@pytest.mark.parametrize("budget", [None, 200])
def test_linear_scores_of_forty_features_are_exact(spark, budget):
    rng = np.random.default_rng(2)
    x, back, w = rng.normal(0, 1, (4, 40)), rng.normal(0, 1, (9, 40)), rng.normal(0, 1, 40)
    df, names = frame(spark, x)
    got = matrix(shapley.kernel_shapley(df, "id", names, dicts(back, names), lambda m: m @ w, budget), names)
    assert np.allclose(got, w * (x - back.mean(axis=0)))
    linear = matrix(explain.linear_attribution(df, "id", names, w), names)
    own = matrix(shapley.kernel_shapley(df, "id", names, dicts(x, names), lambda m: m @ w, budget), names)
    assert np.allclose(own, linear)


def test_sampled_values_add_up_and_come_near(spark):
    rng = np.random.default_rng(3)
    x, back = rng.normal(0, 1, (3, 14)), rng.normal(0, 1, (4, 14))
    df, names = frame(spark, x)
    got = matrix(shapley.kernel_shapley(df, "id", names, dicts(back, names), curved, 3000), names)
    assert np.allclose(got.sum(axis=1), curved(x) - curved(back).mean())
    want = np.array([np.r_[defined(r[:5], back[:, :5], curved), np.zeros(9)] for r in x])
    assert np.abs(got - want).max() < 0.1
    again = matrix(shapley.kernel_shapley(df.repartition(3), "id", names, dicts(back, names), curved, 3000), names)
    assert (got == again).all()


def test_one_feature_and_missing_values(spark):
    df, names = frame(spark, np.array([[2.0], [5.0]]))
    holed = df.unionByName(spark.createDataFrame([(2, None)], "id long, f0 double"))
    got = {r["id"]: r["shap"] for r in shapley.kernel_shapley(holed, "id", names, [{"f0": 1.0}], lambda m: m[:, 0] * 3).collect()}
    assert got == {0: pytest.approx(3.0), 1: pytest.approx(12.0), 2: None}
    assert shapley.kernel_shapley(df.limit(0), "id", names, [{"f0": 1.0}], lambda m: m[:, 0]).collect() == []


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (300, 12)), 2)
    y = (x[:, 0] * x[:, 1] > 0) + 2.0 * (x[:, 2] > 0.5) + x[:, 3]
    df, names = frame(spark, x)
    df = df.join(spark.createDataFrame([(i, float(v), float(v > 1)) for i, v in enumerate(y)], "id long, y double, c double"), "id")
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).cache(), names, x


REGRESSORS = {"tree": lambda: DecisionTreeRegressor(maxDepth=5), "forest": lambda: RandomForestRegressor(numTrees=4, maxDepth=5, seed=1), "boosted": lambda: GBTRegressor(maxIter=4, maxDepth=3, seed=1)}


@pytest.mark.parametrize("kind", sorted(REGRESSORS))
def test_tree_paths_equal_the_definition(spark, fitted, kind):
    df, names, x = fitted
    model = REGRESSORS[kind]().setLabelCol("y").fit(df)
    leaves = shapley.tree_leaves(model)
    predicted = np.array([r[0] for r in model.transform(df).orderBy("id").select("prediction").collect()])
    assert np.allclose(shapley.leaf_score(leaves)(x), predicted)
    back = x[200:206]
    got = matrix(shapley.tree_shapley(df.where("id < 4"), "id", names, leaves, dicts(back, names)), names)
    assert np.allclose(got, [defined(r, back, shapley.leaf_score(leaves)) for r in x[:4]])


def test_training_shares_stand_for_a_background(spark, fitted):
    df, names, x = fitted
    leaves = shapley.tree_leaves(DecisionTreeRegressor(maxDepth=4, labelCol="y").fit(df))
    got = matrix(shapley.tree_shapley(df, "id", names, leaves), names)
    score = shapley.leaf_score(leaves)(x)
    # the whole tree without any feature is the mean of the training rows
    assert np.allclose(got.sum(axis=1), score - score.mean())


@pytest.mark.parametrize("forest", [False, True])
def test_class_probabilities(spark, fitted, forest):
    df, names, x = fitted
    estimator = RandomForestClassifier(numTrees=3, maxDepth=4, seed=2) if forest else DecisionTreeClassifier(maxDepth=4)
    model = estimator.setLabelCol("c").fit(df)
    leaves = shapley.tree_leaves(model, of_class=1)
    p = np.array([r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()])
    assert np.allclose(shapley.leaf_score(leaves)(x), p)
    got = matrix(shapley.tree_shapley(df, "id", names, leaves, dicts(x[:20], names)), names)
    assert np.allclose(got.sum(axis=1), p - p[:20].mean())


def test_boosted_margin(spark, fitted):
    df, names, x = fitted
    model = GBTClassifier(maxIter=3, maxDepth=3, labelCol="c", seed=1).fit(df)
    margin = np.array([r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("rawPrediction")[1]).collect()])
    assert np.allclose(shapley.leaf_score(shapley.tree_leaves(model))(x), margin)


def test_categories_on_a_path():
    nodes = {
        0: {"leftChild": 1, "rightChild": 2, "split": {"featureIndex": 0, "leftCategoriesOrThreshold": [0.0, 2.0], "numCategories": 4}, "impurityStats": [10.0], "rawCount": 10},
        1: {"leftChild": -1, "rightChild": -1, "split": None, "impurityStats": [4.0], "rawCount": 4, "prediction": 3.0},
        2: {"leftChild": 3, "rightChild": 4, "split": {"featureIndex": 0, "leftCategoriesOrThreshold": [1.0], "numCategories": 4}, "impurityStats": [6.0], "rawCount": 6},
        3: {"leftChild": -1, "rightChild": -1, "split": None, "impurityStats": [5.0], "rawCount": 5, "prediction": -1.0},
        4: {"leftChild": -1, "rightChild": -1, "split": None, "impurityStats": [1.0], "rawCount": 1, "prediction": 8.0},
    }
    leaves = shapley._leaves(nodes, 1.0, lambda node: node["prediction"])
    assert shapley.leaf_score(leaves)(np.array([[0.0], [1.0], [2.0], [3.0]])).tolist() == [3.0, -1.0, 3.0, 8.0]
    assert shapley.tree_values(np.array([[3.0]]), leaves)[0, 0] == pytest.approx(8 - (4 * 3 - 5 + 8) / 10)


def test_scored_tables_take_more_than_ten_features(spark):
    rng = np.random.default_rng(5)
    x, back = rng.normal(0, 1, (3, 13)), rng.normal(0, 1, (2, 13))
    df, names = frame(spark, x)
    score = lambda t: t.withColumn("score", F.col("f0") * F.col("f1") + 2 * F.col("f12"))
    got = matrix(explain.shapley(df, "id", names, dicts(back, names), score, budget=500), names)
    in_task = matrix(shapley.kernel_shapley(df, "id", names, dicts(back, names), lambda m: m[:, 0] * m[:, 1] + 2 * m[:, 12], 500), names)
    assert np.allclose(got, in_task)


def test_global_explanation_uses_all_rows(spark):
    df = spark.createDataFrame([(i, float(i), 1.0) for i in range(700)], "id long, a double, b double")
    score = lambda t: t.withColumn("score", F.col("a") * 2 + F.col("b"))
    got = {r["feature"]: r["mean_abs_shap"] for r in explain.explain_globally(df, "id", ["a", "b"], score, background=5).collect()}
    back = np.mean([r["a"] for r in explain.background_rows(df, ["id"], ["a", "b"], 5)])
    assert got == {"a": pytest.approx(np.abs(2 * (np.arange(700) - back)).mean()), "b": pytest.approx(0.0)}
