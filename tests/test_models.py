"""Model, neighbour, cluster and attribution operators against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrule.core.moments import grouped_moments, moments
from plumbrule.operators import bayes, clusters, density, ensembles, explain, linear_models, metrics, model_zoo, neighbours, reduce, split, tree_splits


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = 2 + x @ [1.5, -2.0, 0.0] + rng.normal(scale=0.1, size=300)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").cache(), x, y


def test_moments(xy):
    df, x, _ = xy
    m = moments(df, ["a", "b", "c"])
    assert m.n == 300
    assert np.allclose(m.covariance(1), np.cov(x.T))
    assert np.allclose(m.raw(), x.T @ x)


def test_wide_moments_match(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 30))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"f{i}" for i in range(30)])
    assert np.allclose(moments(df, df.columns).covariance(1), np.cov(x.T))


def test_grouped_moments(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, x double")
    got = grouped_moments(df, ["x"], "g")
    assert got["a"].mean[0] == 2.0 and got["a"].scatter[0, 0] == 2.0 and got["b"].n == 1


def test_least_squares_family(xy):
    df, x, y = xy
    m = linear_models.xy_moments(df, ["a", "b", "c"], "y")
    ones = np.c_[np.ones(len(x)), x]
    want = np.linalg.lstsq(ones, y, rcond=None)[0]
    fit = linear_models.least_squares(m, ["a", "b", "c"], "y")
    assert np.allclose([fit.intercept, *fit.weights], want)
    gd = linear_models.gradient_descent(m, ["a", "b", "c"], "y", 0.1, 500)
    assert np.allclose([gd.intercept, *gd.weights], want, atol=1e-6)
    assert gd.history[0] == pytest.approx(np.mean(y**2)) and gd.history[-1] < gd.history[0]
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(linear_models.ridge(m, ["a", "b", "c"], "y", 5.0).weights, np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc))
    lasso = linear_models.lasso(m, ["a", "b", "c"], "y", 0.5)
    assert abs(lasso.weights[2]) < 1e-9 and abs(lasso.weights[0]) < 1.5
    with pytest.raises(ValueError):
        linear_models.elastic_net(m, ["a"], "y", 1.0, 1.5)


def test_bayesian_variance(xy):
    df, x, y = xy
    m = linear_models.xy_moments(df, ["a", "b"], "y")
    fit = linear_models.bayesian_regression(m, ["a", "b"], "y", 1.0, 4.0)
    ones = np.c_[np.ones(len(x)), x[:, :2]]
    cov = np.linalg.inv(np.eye(3) + 4 * ones.T @ ones)
    row = fit.predict(df).where("id = 0").first()
    assert row["variance"] == pytest.approx(0.25 + ones[0] @ cov @ ones[0])
    assert row["prediction"] == pytest.approx(ones[0] @ (4 * cov @ ones.T @ y))


def test_perceptron_separates(spark):
    rows = [(float(i % 10), float(i // 10), int((i % 10) + (i // 10) > 9)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(1)
    fit = linear_models.perceptron(df, ["a", "b"], "y", 0.1, 200)
    wrong = df.where(linear_models.perceptron_class(fit) != F.col("y")).count()
    assert wrong <= 2 and fit.history[-1] <= fit.history[0]


def test_gaussian_probabilities(spark):
    rng = random.Random(5)
    rows = [("ab"[i % 2], rng.gauss(3 * (i % 2), 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = bayes.score_gaussian(df, bayes.gaussian_nb(df, "g", ["x"]), ["x"])
    assert out.where(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, v: a + v) - 1) > 1e-9).isEmpty()
    assert out.where("prediction = g").count() > 170


def test_negative_counts_are_refused(spark):
    df = spark.createDataFrame([("a", "t", -1)], "g string, token string, n int")
    with pytest.raises(Exception, match="negative"):
        bayes.multinomial_nb(df, "g").collect()


def test_root_split(spark):
    rows = [(float(i), float(i % 3), "x" if i < 37 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, g string")
    row = tree_splits.best_split_class(df, "g", ["b", "a"], "entropy").first()
    assert (row["feature"], row["threshold"]) == ("a", 36.5)


def test_constant_features_have_no_split(spark):
    df = spark.createDataFrame([(1.0, "x"), (1.0, "y")], "a double, g string")
    assert tree_splits.best_split_class(df, "g", ["a"]).isEmpty()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    v = np.r_[rng.normal(0, 0.3, (60, 2)), rng.normal(2, 0.3, (60, 2)), np.repeat([[5.0, 5.0]], 40, axis=0), rng.uniform(-3, 8, (30, 2))]
    label = [0] * 60 + [1] * 60 + [2] * 40 + [3] * 30
    rows = [(i, list(map(float, p)), k, float(p[0]), float(p[1])) for i, (p, k) in enumerate(zip(v, label))]
    return spark.createDataFrame(rows, "id long, v array<double>, label int, x double, y double").cache(), v, np.array(label)


def brute(v):
    return np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2))


@pytest.mark.parametrize("block", [4096, 37])
def test_nearest(points, block):
    df, v, _ = points
    d = brute(v)
    np.fill_diagonal(d, np.inf)
    got = {(r["id"], r["rank"]): r["distance"] for r in neighbours.nearest(df, df, 4, True, block).collect()}
    want = np.sort(d, axis=1)[:, :4]
    assert all(got[i, k + 1] == pytest.approx(want[i, k]) for i in range(len(v)) for k in range(4))


def test_silhouette_brute_force(points):
    df, v, label = points
    d = brute(v)
    got = {r["id"]: r["silhouette"] for r in neighbours.silhouette(df).collect()}
    for i in range(len(v)):
        a = d[i, label == label[i]].sum() / ((label == label[i]).sum() - 1)
        b = min(d[i, label == k].mean() for k in set(label) - {label[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b))


def slow_dbscan(v, eps, least):
    d = brute(v)
    near = [np.flatnonzero(r <= eps) for r in d]
    core = np.array([len(n) >= least for n in near])
    label = np.full(len(v), -1)
    k = 0
    for i in range(len(v)):
        if core[i] and label[i] == -1:
            todo, label[i] = [i], k
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] == -1:
                        label[j] = k
                        todo.append(j)
            k += 1
    for i in range(len(v)):
        if not core[i] and any(core[near[i]]):
            label[i] = min(label[j] for j in near[i] if core[j])
    return label, core


@pytest.mark.parametrize("eps,least", [(0.25, 5), (0.6, 4), (0.12, 3)])
def test_dbscan_brute_force(points, eps, least):
    df, v, _ = points
    label, core = slow_dbscan(v, eps, least)
    got = {r["id"]: (r["cluster"], r["core"]) for r in density.dbscan(df, "id", ["x", "y"], eps, least).collect()}
    assert len(got) == len(v)
    assert [got[i][1] for i in range(len(v))] == core.tolist()
    assert [got[i][0] for i in range(len(v))] == label.tolist()


def test_components_of_a_chain(spark):
    nodes = spark.range(60).select(F.col("id").alias("node"))
    links = spark.range(1, 60).where("id != 40").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = {r["node"]: r["label"] for r in density.components(nodes, links).collect()}
    assert got == {i: 0 if i < 40 else 40 for i in range(60)}


def test_external_scores_of_equal_partitions(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 2)] * 7, "t string, c int")
    row = clusters.external_quality(df, "t", "c").first()
    assert all(row[k] == pytest.approx(1.0) for k in ("ari", "nmi", "homogeneity", "completeness", "v_measure"))


def test_cluster_analysis_finds_three_groups(spark):
    rows = [(i, float(10 * (i // 3) + i % 3 * 0.1), float(-5 * (i // 3))) for i in range(9)]
    out = clusters.cluster_analysis(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], "id", 4)
    assert out.where("best").first()["k"] == 3


def test_pca_and_reconstruction(xy):
    df, x, _ = xy
    p = reduce.pca(df, ["a", "b", "c"])
    assert np.allclose(p.variance, np.linalg.eigvalsh(np.cov(x.T))[::-1])
    full = reduce.reconstruction_error(df, p).agg(F.max("error")).first()[0]
    assert full == pytest.approx(0.0, abs=1e-12)
    table = reduce.reconstruction_by_k(df, ["a", "b", "c"]).collect()
    one = reduce.reconstruction_error(df, reduce.pca(df, ["a", "b", "c"], 1)).agg(F.avg("error")).first()[0]
    assert table[0]["mse"] == pytest.approx(one) and table[2]["kept_variance"] == pytest.approx(1.0)


def test_kernel_pca_with_all_rows_as_landmarks(xy):
    df, x, _ = xy
    z = x[:40]
    k = np.exp(-0.5 * ((z[:, None] - z[None]) ** 2).sum(2))
    h = np.eye(40) - 1 / 40
    values = np.linalg.eigvalsh(h @ k @ h)[::-1]
    out = reduce.kernel_pca(df.where("id < 40"), ["a", "b", "c"], z, 2, gamma=0.5).select("kpc").collect()
    scores = np.array([r["kpc"] for r in out])
    assert np.allclose((scores**2).sum(0), values[:2])


def test_shapley_sums_to_the_difference(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), float(i * i)) for i in range(6)], "id long, a double, b double, c double")
    back = [{"a": 1.0, "b": 0.0, "c": 2.0}, {"a": 0.0, "b": 2.0, "c": 1.0}]
    score = lambda d: d.withColumn("score", F.col("a") * F.col("b") + F.col("c"))
    total = {r["id"]: r["s"] for r in explain.shapley(df, "id", ["a", "b", "c"], back, score).groupBy("id").agg(F.sum("shap").alias("s")).collect()}
    base = np.mean([b["a"] * b["b"] + b["c"] for b in back])
    assert all(total[i] == pytest.approx(i * (i % 3) + i * i - base) for i in range(6))


def test_lime_recovers_a_linear_model(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id long, a double, b double")
    score = lambda d: d.withColumn("score", 4 * F.col("a") - 2 * F.col("b"))
    got = {r["feature"]: r for r in explain.lime(df, "id", ["a", "b"], [1.0, 1.0], score, samples=2000, alpha=0.0).collect()}
    assert got["a"]["lime"] == pytest.approx(4.0, abs=1e-6) and got["b"]["lime"] == pytest.approx(-2.0, abs=1e-6)
    assert got["a"]["r2"] == pytest.approx(1.0)


def test_auc_counts_ties_half(spark):
    rows = [(0.9, True), (0.5, True), (0.5, False), (0.1, False)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    pairs = [(a, b) for (a, ya), (b, yb) in itertools.product(rows, rows) if ya and not yb]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert metrics.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(want)


def test_majority_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b", "a", "c")], "m1 string, m2 string, m3 string")
    assert df.select(metrics.majority(["m1", "m2", "m3"], ["a", "b", "c"])).first()[0] == "a"


def test_folds_are_balanced(spark):
    df = spark.range(103).select("id", F.when(F.col("id") < 60, "hot").otherwise("cold").alias("g"))
    sizes = split.stratified_folds(df, "g", ["id"], 5).groupBy("g", "fold").count()
    spread = sizes.groupBy("g").agg((F.max("count") - F.min("count")).alias("d"))
    assert spread.agg(F.max("d")).first()[0] <= 1
    assert split.stratified_split(df, "g", ["id"]).where("is_test").count() == 12 + 9


def test_prepare_refuses_bad_targets(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "x long, t string")
    with pytest.raises(ValueError):
        model_zoo.prepare_dataset(df, "gone")
    with pytest.raises(ValueError):
        model_zoo.prepare_dataset(df, "t", ["x"], "classification")
    with pytest.raises(ValueError):
        model_zoo.prepare_dataset(df, "t", ["x"], "regression")


def test_small_leaderboard_and_saved_model(spark, tmp_path):
    from plumbrule.operators.scoring import score_batch
    from plumbrule.sources.tables import load_model, save_model

    rows = [(i, float(i % 10) + (i % 3) * 10, None if i % 9 == 0 else "uvw"[i % 3], "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, x double, t string, target string")
    data = model_zoo.prepare_dataset(df, "target", ["x", "t"], "classification", ["id"])
    name, model, board = model_zoo.train_best(data, ["Gaussian NB", "Decision Tree"], k=2, trees=5)
    assert set(board.columns) == {"model", "cv_accuracy", "cv_f1_macro", "test_accuracy", "test_f1_macro"}
    assert board.count() == 2 and name in ("Gaussian NB", "Decision Tree")
    save_model(model, str(tmp_path / "m"), df, [name], data.classes)
    again, meta = load_model(spark, str(tmp_path / "m"), df, [name])
    scored = score_batch(df, again, meta["classes"], ["id", "target"])
    assert scored.where("class = target").count() > 80
    with pytest.raises(ValueError):
        load_model(spark, str(tmp_path / "m"), df.where("id > 3"))
    with pytest.raises(ValueError):
        load_model(spark, str(tmp_path / "m"), models=["other"])


def test_bagging_needs_drawn_rows_for_oob(spark):
    df = spark.createDataFrame([(i, float(i % 20), float(i % 20 > 9)) for i in range(120)], "id long, x double, y double")
    bag = ensembles.Bagging(estimators=4, depth=3).fit(df, ["x"], "y", ["id"])
    assert bag.oob(df).first()["oob_score"] > 0.8
    assert bag.transform(df).where("prediction = y").count() > 110
    whole = ensembles.Bagging(estimators=2, depth=3, replace=False).fit(df, ["x"], "y", ["id"])
    assert whole.oob(df).first()["oob_score"] is None
    assert sum(bag.importances().values()) == pytest.approx(1.0)


def test_boosting_stops_on_a_perfect_stump(spark):
    df = spark.createDataFrame([(float(i), float(i > 24)) for i in range(50)], "x double, y double")
    fit = ensembles.Samme(rounds=5).fit(df, ["x"], "y")
    assert len(fit.models) == 1 and fit.errors == [0.0] and fit.alphas == [1e6]


def test_nearest_information_brute_force(spark):
    from plumbrule.operators.association import nearest_information

    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(0, 1, 40), rng.normal(2, 1, 50), [7.0]]
    g = ["a"] * 40 + ["b"] * 50 + ["c"]
    psi = lambda n: -0.57721566490153286 + sum(1 / j for j in range(1, n))
    ks, sizes, ms = [], [], []
    for i in range(90):
        same = np.sort([abs(x[i] - x[j]) for j in range(91) if g[j] == g[i] and j != i])
        ks.append(psi(3))
        sizes.append(psi(len(same) + 1))
        # the shrunken radius leaves out the k-th neighbour itself
        ms.append(psi(int(sum(abs(x - x[i]) < same[2]))))
    want = max(0.0, psi(90) + np.mean(ks) - np.mean(sizes) - np.mean(ms))
    df = spark.createDataFrame(list(zip(map(float, x), g)), "x double, g string")
    assert nearest_information(df, "g", ["x"]).first()["mutual_information"] == pytest.approx(want, abs=0.02)


def test_noise_does_not_depend_on_partitions(spark):
    from plumbrule.operators.clean import add_noise

    df = spark.createDataFrame([(i, float(i % 7)) for i in range(3000)], "id long, x double")
    one, two = (sorted(add_noise(f, ["x"], 2.0, key=["id"]).collect()) for f in (df.coalesce(1), df.repartition(7)))
    assert one == two
    gaps = np.array([r["x"] - r["id"] % 7 for r in one])
    assert abs(gaps.mean()) < 0.15 and abs(gaps.std() - 2) < 0.15


def test_round_weights():
    assert ensembles.round_weight(0.0, 3, 0.5) == 5e5
    assert ensembles.round_weight(0.7, 3, 1.0) is None
    assert ensembles.round_weight(0.25, 3, 1.0) == pytest.approx(np.log(3) + np.log(2))


def test_nearest_information_of_tied_values(spark):
    """A number that determines forty classes tells all of them; one that is the same everywhere tells nothing."""
    from plumbrule.operators.association import nearest_information

    df = spark.createDataFrame([(float(i % 40), 1.0, f"c{i % 40}") for i in range(2000)], "x double, flat double, g string")
    found = {r["feature"]: r["mutual_information"] for r in nearest_information(df, "g", ["x", "flat"]).collect()}
    assert found["x"] == pytest.approx(np.log(40), abs=0.02)
    assert found["flat"] == pytest.approx(0.0, abs=0.02)


def test_multinomial_keeps_documents_without_known_words(spark):
    from plumbrule.operators import bayes

    train = spark.createDataFrame([(1, "a", "x", 3), (2, "b", "y", 1), (3, "b", "y", 2)], "doc long, label string, token string, n long")
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "doc long")
    priors = bayes.class_log_priors(spark.createDataFrame([("a",), ("b",), ("b",)], "label string"), "label")
    tokens = train.select("doc", "token", "n").union(spark.createDataFrame([(4, "unknown", 1)], "doc long, token string, n long"))
    found = {r["doc"]: (r["prediction"], r["log_score"]) for r in bayes.score_multinomial(tokens, "doc", bayes.multinomial_nb(train, "label"), priors, docs).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and found[1][0] == "a"
    assert found[4] == found[5] == ("b", pytest.approx(np.log(2 / 3)))


def test_correlation_uses_the_rows_of_each_pair(spark):
    from plumbrule.operators.explore import correlation_matrix

    rows = [(float(i), float(i * i), float(i) if i % 10 == 0 else None) for i in range(100)]
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    x = np.arange(100.0)
    assert got["a", "b"] == pytest.approx(np.corrcoef(x, x * x)[0, 1]) and got["a", "c"] == pytest.approx(1.0)


def test_margins_and_support_vectors(spark):
    df = spark.createDataFrame([(float(i % 20), float(i % 7), "hi" if i % 20 > 9 else "lo") for i in range(200)], "a double, b double, y string")
    fit = model_zoo.MarginClassifier(steps=20).fit(df, ["a", "b"], "y")
    out = fit.transform(df)
    assert out.where("prediction = y").count() >= 190
    assert fit.support_vectors(df).where("abs(margin - 1) > 0.25").isEmpty()
    ring = spark.createDataFrame([(float(a), float(b), "in" if a * a + b * b < 6 else "out") for a in range(-4, 5) for b in range(-4, 5)], "a double, b double, y string")
    rbf = model_zoo.MarginClassifier(10.0, "rbf", 0.5, 100, 20).fit(ring, ["a", "b"], "y").transform(ring)
    assert rbf.where("prediction = y").count() >= 75
    with pytest.raises(ValueError):
        model_zoo.MarginClassifier().fit(df.where("y = 'hi'"), ["a"], "y")


def test_bagging_computes_its_rows_once(spark):
    """Members read a written table, not the rows' expressions; out-of-bag members are known without a join."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return float(x % 7)

    rows = spark.range(200).select("id", F.udf(counted, "double")("id").alias("x")).withColumn("y", (F.col("id") % 7 > 3).cast("double"))
    bag = ensembles.Bagging(estimators=3, depth=2).fit(rows, ["x"], "y", ["id"])
    assert seen.value == 200
    keys = spark.createDataFrame([(i // 2 if i % 10 else None, float(i % 7), float(i % 7 > 3)) for i in range(200)], "id long, x double, y double")
    free = split.bootstrap_weights(keys.where("id IS NOT NULL").select("id").distinct(), ["id"], 3).where("weight = 0").select("id").distinct()
    assert bag.oob(keys).first()["rows"] == keys.join(free, "id").count()
