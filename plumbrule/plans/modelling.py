"""Model, neighbour, cluster, projection, attribution and scoring queries."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plumbrule.core.session import cut_lineage
from plumbrule.operators import (
    bayes,
    clusters,
    density,
    ensembles,
    explain,
    level_trees,
    linear_models,
    lloyd,
    model_zoo,
    neighbours,
    prep,
    reduce,
    scoring,
    shapley,
    split,
    tree_splits,
)
from plumbrule.plans.associations import rounded
from plumbrule.plans.exploration import STOP, TOKENS_SQL
from plumbrule.plans.registry import query, table
from plumbrule.streaming import monitor

# least squares


def priced(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / 1000).alias("price"))


PRICED = "p AS (SELECT l_quantity, l_discount, l_tax, l_extendedprice / 1000 AS price FROM lineitem)"
SUMS = "s AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mx, avg(price) AS my, regr_sxx(price, l_quantity) AS sxx, regr_sxy(price, l_quantity) AS sxy FROM p)"


def terms_sql(slope: str, name: str = "l_quantity") -> str:
    return f"""SELECT '{name}' AS term, round({slope}, 6) + 0.0 AS coefficient FROM s UNION ALL SELECT '(intercept)', round(my - mx * ({slope}), 6) + 0.0 FROM s"""


@query("linreg_normal", f"WITH {PRICED}, {SUMS} {terms_sql('sxy / sxx')}")
def q_normal(spark, sf_dir):
    m = linear_models.xy_moments(priced(spark, sf_dir), ["l_quantity"], "price")
    return rounded(linear_models.least_squares(m, ["l_quantity"], "price").table(spark), "coefficient")


@query("ridge_1d", f"WITH {PRICED}, {SUMS} {terms_sql('sxy / (sxx + 1000)')}")
def q_ridge(spark, sf_dir):
    m = linear_models.xy_moments(priced(spark, sf_dir), ["l_quantity"], "price")
    return rounded(linear_models.ridge(m, ["l_quantity"], "price", 1000.0).table(spark), "coefficient")


@query("lasso_1d", f"WITH {PRICED}, {SUMS} {terms_sql('sign(sxy) * greatest(abs(sxy) - 0.05 * n, 0) / (sxx + 1e-12)')}")
def q_lasso(spark, sf_dir):
    m = linear_models.xy_moments(priced(spark, sf_dir), ["l_quantity"], "price")
    return rounded(linear_models.lasso(m, ["l_quantity"], "price", 0.05).table(spark), "coefficient")


@query("elastic_net_1d", f"WITH {PRICED}, {SUMS} {terms_sql('sign(sxy) * greatest(abs(sxy) - 0.02 * n, 0) / (sxx + 0.02 * n + 1e-12)')}")
def q_elastic(spark, sf_dir):
    m = linear_models.xy_moments(priced(spark, sf_dir), ["l_quantity"], "price")
    return rounded(linear_models.elastic_net(m, ["l_quantity"], "price", 0.04, 0.5).table(spark), "coefficient")


GD = f"""WITH {PRICED}, z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, price AS y FROM p),
  s AS (SELECT avg(x * y) AS sxy, avg(y) AS my FROM z)"""


def standardized_price(spark, sf_dir):
    return prep.standard_scale(priced(spark, sf_dir), ["l_quantity"]).withColumnRenamed("l_quantity", "x")


@query(
    "linreg_gd",
    GD + " SELECT 'x' AS term, round(sxy * (1 - pow(1 - 0.02::DOUBLE, 200)), 5) + 0.0 AS coefficient FROM s UNION ALL SELECT '(intercept)', round(my * (1 - pow(1 - 0.02::DOUBLE, 200)), 5) FROM s",
)
def q_gd(spark, sf_dir):
    m = linear_models.xy_moments(standardized_price(spark, sf_dir), ["x"], "price")
    return rounded(linear_models.gradient_descent(m, ["x"], "price", 0.01, 200).table(spark), "coefficient", digits=5)


@query(
    "adaline_gd",
    """WITH b AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, (l_returnflag = 'R')::INTEGER AS y FROM lineitem), s AS (SELECT avg(x * y) AS sxy, avg(y) AS my FROM b)
    SELECT 'l_quantity' AS term, round(sxy * (1 - pow(1 - 0.05::DOUBLE, 50)), 6) + 0.0 AS coefficient FROM s UNION ALL SELECT '(intercept)', round(my * (1 - pow(1 - 0.05::DOUBLE, 50)), 6) FROM s""",
)
def q_adaline(spark, sf_dir):
    df = prep.standard_scale(table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y")), ["l_quantity"])
    m = linear_models.xy_moments(df, ["l_quantity"], "y")
    return rounded(linear_models.adaline(m, ["l_quantity"], "y", 0.05, 50).table(spark), "coefficient")


@query("regularization_path")
def q_path(spark, sf_dir):
    names = ["l_quantity", "l_discount", "l_tax"]
    m = linear_models.xy_moments(priced(spark, sf_dir), names, "price")
    return linear_models.regularization_path(spark, m, names, "price", [10.0 ** (-3 + i / 6) for i in range(25)])


@query(
    "bayesian_regression",
    """WITH s AS (SELECT count(*) AS n, sum(p_size)::DOUBLE AS sx, sum(p_size * p_size)::DOUBLE AS sxx, sum(p_retailprice / 100) AS sy, sum(p_size * p_retailprice / 100) AS sxy FROM part),
    a AS (SELECT 1.0 + 0.5::DOUBLE * n AS a, 0.5::DOUBLE * sx AS b, 1.0 + 0.5::DOUBLE * sxx AS d, sy, sxy FROM s),
    c AS (SELECT d / (a * d - b * b) AS s00, -b / (a * d - b * b) AS s01, a / (a * d - b * b) AS s11, sy, sxy FROM a)
    SELECT p_partkey, round(0.5 * (s00 * sy + s01 * sxy) + 0.5 * (s01 * sy + s11 * sxy) * p_size, 6) AS prediction, round(2.0 + s00 + 2 * s01 * p_size + s11 * p_size * p_size, 6) AS variance FROM part, c""",
)
def q_bayesian(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 100).alias("y"))
    fit = linear_models.bayesian_regression(linear_models.xy_moments(df, ["p_size"], "y"), ["p_size"], "y", 1.0, 0.5)
    return rounded(fit.predict(df), "prediction", "variance").select("p_partkey", "prediction", "variance")


@query("perceptron")
def q_perceptron(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_size", "p_retailprice", ((F.col("p_size") > 25) & (F.col("p_retailprice") > 950)).cast("int").alias("y"))
    return linear_models.perceptron(prep.standard_scale(df, ["p_size", "p_retailprice"]), ["p_size", "p_retailprice"], "y", 0.01, 5).table(spark)


# naive Bayes

NB_STATS = """g AS (SELECT event_type, count(*) AS n, avg(value) AS m0, var_pop(value) AS v0, avg(user_id) AS m1, var_pop(user_id) AS v1 FROM events GROUP BY 1),
 whole AS (SELECT var_pop(x) AS v FROM (SELECT value AS x FROM events UNION ALL SELECT user_id::DOUBLE FROM events)),
 l AS (SELECT event_id, g.event_type, ln(n / (SELECT count(*) FROM events) + 1e-12) - 0.5 * (ln(2 * pi() * (v0 + 1e-9 * greatest(v, 1))) + pow(value - m0, 2) / (v0 + 1e-9 * greatest(v, 1))
     + ln(2 * pi() * (v1 + 1e-9 * greatest(v, 1))) + pow(user_id - m1, 2) / (v1 + 1e-9 * greatest(v, 1))) AS ll FROM events, g, whole)"""


@query(
    "gaussian_nb",
    f"""WITH {NB_STATS} SELECT event_id, arg_max(event_type, ll) AS prediction, round(max(ll), 6) + 0.0 AS best, round(max(ll) + ln(sum(exp(ll - mx))), 6) + 0.0 AS log_evidence
    FROM (SELECT *, max(ll) OVER (PARTITION BY event_id) AS mx FROM l) GROUP BY event_id""",
)
def q_gaussian(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    fit = bayes.gaussian_nb(df, "event_type", ["value", "user_id"])
    out = bayes.score_gaussian(df, fit, ["value", "user_id"])
    best = F.ln(F.array_max("probabilities")) + F.col("log_evidence")
    return rounded(out.select("event_id", "prediction", best.alias("best"), "log_evidence"), "best", "log_evidence")


MNB = f"""WITH {TOKENS_SQL}, voc AS (SELECT token FROM tok GROUP BY token ORDER BY count(*) DESC, token LIMIT 5000), bag AS (SELECT doc_id, lang, token, count(*) AS n FROM tok JOIN voc USING (token) GROUP BY ALL),
  cl AS (SELECT lang, sum(n) AS nc FROM bag GROUP BY lang), ct AS (SELECT lang, token, sum(n) AS n FROM bag GROUP BY ALL),
  lp AS (SELECT cl.lang, voc.token, ln((coalesce(ct.n, 0) + 1.0) / (nc + (SELECT count(*) FROM voc))) AS log_prob FROM cl CROSS JOIN voc LEFT JOIN ct ON ct.lang = cl.lang AND ct.token = voc.token)"""


def language_bag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # read several times by the model: keep the counts, not the exploded text
    return docs, prep.token_matrix(docs, "text", "doc_id", STOP, 5000).persist(StorageLevel.MEMORY_AND_DISK)


@query(
    "multinomial_nb",
    MNB
    + """, pr AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM documents)) AS lp FROM documents GROUP BY lang),
    sc AS (SELECT doc_id, lp.lang, sum(n * log_prob) + any_value(pr.lp) AS s FROM bag JOIN lp USING (token) JOIN pr ON pr.lang = lp.lang GROUP BY doc_id, lp.lang)
    SELECT d.doc_id, coalesce(arg_max(sc.lang, s), (SELECT arg_max(lang, lp) FROM pr)) AS prediction, round(coalesce(max(s), (SELECT max(lp) FROM pr)), 4) AS log_score
    FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN sc USING (doc_id) GROUP BY d.doc_id""".replace("JOIN lp USING (token)", "JOIN lp ON lp.token = bag.token"),
)
def q_multinomial(spark, sf_dir):
    docs, bag = language_bag(spark, sf_dir)
    labelled = bag.join(docs.select("doc_id", "lang"), "doc_id")
    logs = bayes.multinomial_nb(labelled, "lang")
    return rounded(bayes.score_multinomial(bag, "doc_id", logs, bayes.class_log_priors(docs, "lang"), docs), "log_score", digits=4)


@query(
    "top_words",
    MNB + """ SELECT lang AS label, token, round(log_prob, 6) AS log_prob, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY log_prob DESC, token) AS rank FROM lp) WHERE rank <= 15""",
)
def q_top_words(spark, sf_dir):
    docs, bag = language_bag(spark, sf_dir)
    logs = bayes.multinomial_nb(bag.join(docs.select("doc_id", "lang"), "doc_id"), "lang")
    return rounded(bayes.top_words(logs), "log_prob").select("label", "token", "log_prob", "rank")


@query(
    "bernoulli_nb",
    """WITH b AS (SELECT event_id, event_type, (value > 40)::INTEGER AS x0, (user_id > 40)::INTEGER AS x1 FROM events),
    g AS (SELECT event_type, ln(count(*) / (SELECT count(*) FROM b)) AS lp, (sum(x0) + 1) / (count(*) + 2.0) AS p0, (sum(x1) + 1) / (count(*) + 2.0) AS p1 FROM b GROUP BY 1),
    l AS (SELECT event_id, g.event_type, lp + ln(CASE WHEN x0 = 1 THEN p0 ELSE 1 - p0 END) + ln(CASE WHEN x1 = 1 THEN p1 ELSE 1 - p1 END) AS ll FROM b, g)
    SELECT event_id, arg_max(event_type, ll) AS prediction, round(max(ll), 6) AS best FROM l GROUP BY event_id""",
)
def q_bernoulli(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(
        "event_id", "event_type", (F.col("value") > 40).cast("int").alias("x0"), (F.col("user_id") > 40).cast("int").alias("x1")
    )
    out = bayes.score_bernoulli(df, bayes.bernoulli_nb(df, "event_type", ["x0", "x1"]), ["x0", "x1"])
    best = F.ln(F.array_max("probabilities")) + F.col("log_evidence")
    return rounded(out.select("event_id", "prediction", best.alias("best")), "best")


@query(
    "dummy_baseline",
    """SELECT o_orderpriority AS prediction, round(count(*) / (SELECT count(*) FROM orders), 6) AS accuracy FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
)
def q_dummy(spark, sf_dir):
    return rounded(bayes.dummy_baseline(table(spark, sf_dir, "orders"), "o_orderpriority"), "accuracy")


# trees and ensembles


def gini_sql(feature):
    return f"""SELECT '{feature}' AS feature, (v + nv) / 2.0 AS threshold, gain FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nv,
      (1 - list_sum(list_transform(t, lambda k: pow(k / n, 2)))) - cn / n * (1 - list_sum(list_transform(c, lambda k: pow(k / cn, 2))))
       - (n - cn) / n * (1 - (pow((t[1] - c[1]) / nullif(n - cn, 0), 2) + pow((t[2] - c[2]) / nullif(n - cn, 0), 2) + pow((t[3] - c[3]) / nullif(n - cn, 0), 2))) AS gain
      FROM (SELECT v, [sum(a) OVER w, sum(b) OVER w, sum(r) OVER w]::DOUBLE[] AS c, [sum(a) OVER (), sum(b) OVER (), sum(r) OVER ()]::DOUBLE[] AS t, sum(a + b + r) OVER w AS cn, sum(a + b + r) OVER () AS n
        FROM (SELECT {feature}::DOUBLE AS v, count(*) FILTER (y = 0) AS a, count(*) FILTER (y = 1) AS b, count(*) FILTER (y = 2) AS r FROM d GROUP BY 1) WINDOW w AS (ORDER BY v)))
      WHERE nv IS NOT NULL AND gain > 0"""


SPLIT_DATA = "d AS (SELECT l_quantity, l_discount, l_tax, CASE WHEN l_quantity * 2 + l_linenumber * 5 > 70 THEN 0 WHEN l_discount > 0.04 THEN 1 ELSE 2 END AS y, l_extendedprice / 1000 + l_quantity AS t FROM lineitem)"
SPLIT_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def split_data(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_discount",
        "l_tax",
        F.when(F.col("l_quantity") * 2 + F.col("l_linenumber") * 5 > 70, 0).when(F.col("l_discount") > 0.04, 1).otherwise(2).alias("y"),
        (F.col("l_extendedprice") / 1000 + F.col("l_quantity")).alias("t"),
    )


@query(
    "best_split_gini",
    f"WITH {SPLIT_DATA} SELECT feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM ({' UNION ALL '.join(map(gini_sql, SPLIT_FEATURES))}) ORDER BY gain DESC, threshold LIMIT 1",
)
def q_gini(spark, sf_dir):
    return rounded(tree_splits.best_split_class(split_data(spark, sf_dir), "y", SPLIT_FEATURES), "threshold", "gain")


def mse_sql(feature):
    return f"""SELECT '{feature}' AS feature, (v + nv) / 2.0 AS threshold, ((q - s * s / n) - (cq - cs * cs / cn) - ((q - cq) - (s - cs) * (s - cs) / nullif(n - cn, 0))) / n AS gain
      FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nv, sum(n0) OVER w AS cn, sum(s0) OVER w AS cs, sum(q0) OVER w AS cq, sum(n0) OVER () AS n, sum(s0) OVER () AS s, sum(q0) OVER () AS q
        FROM (SELECT {feature}::DOUBLE AS v, count(*)::DOUBLE AS n0, sum(z) AS s0, sum(z * z) AS q0 FROM c GROUP BY 1) WINDOW w AS (ORDER BY v)) WHERE nv IS NOT NULL"""


@query(
    "best_split_mse",
    f"WITH {SPLIT_DATA}, c AS (SELECT *, t - (SELECT avg(t) FROM d) AS z FROM d) SELECT feature, round(threshold, 6) AS threshold, round(gain, 5) AS gain FROM ({' UNION ALL '.join(map(mse_sql, SPLIT_FEATURES))}) ORDER BY gain DESC, threshold LIMIT 1",
)
def q_mse(spark, sf_dir):
    return rounded(rounded(tree_splits.best_split_mse(split_data(spark, sf_dir), "t", SPLIT_FEATURES), "threshold"), "gain", digits=5)


@query(
    "staged_vote",
    """WITH v AS (SELECT event_id, CASE WHEN value > 50 THEN 'a' ELSE 'b' END AS v0, CASE WHEN user_id % 3 = 0 THEN 'a' WHEN user_id % 3 = 1 THEN 'b' ELSE 'c' END AS v1, CASE WHEN event_type = 'view' THEN 'c' ELSE 'b' END AS v2 FROM events),
    l AS (SELECT event_id, unnest([1, 2, 3]) AS r, unnest([v0, v1, v2]) AS c, unnest([0.5, 0.75, 0.4]::DOUBLE[]) AS a FROM v),
    s AS (SELECT l1.event_id, k.r AS round, l1.c, sum(l1.a) AS s FROM l l1 JOIN (SELECT unnest([1, 2, 3]) AS r) k ON l1.r <= k.r GROUP BY ALL)
    SELECT event_id, round, arg_min(c, (-s, c)) AS prediction FROM s GROUP BY event_id, round""",
)
def q_staged(spark, sf_dir):
    u = F.col("user_id") % 3
    df = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("value") > 50, "a").otherwise("b").alias("v0"),
        F.when(u == 0, "a").when(u == 1, "b").otherwise("c").alias("v1"),
        F.when(F.col("event_type") == "view", "c").otherwise("b").alias("v2"),
    )
    return ensembles.staged_votes(df, ["v0", "v1", "v2"], [0.5, 0.75, 0.4], ["a", "b", "c"], ["event_id"])


@query(
    "soft_vote",
    """WITH p AS (SELECT p_partkey, p_size / 51.0::DOUBLE AS a, (p_partkey % 10) / 10.0::DOUBLE AS b, (p_partkey % 7) / 7.0::DOUBLE AS c FROM part)
    SELECT p_partkey, CASE WHEN (a + b + c) / 3 >= ((1 - a) + (1 - b) + (1 - c)) / 3 THEN 'yes' ELSE 'no' END AS prediction, round((a + b + c) / 3, 6) AS p_yes FROM p""",
)
def q_soft(spark, sf_dir):
    a, b, c = F.col("p_size") / 51.0, (F.col("p_partkey") % 10) / 10.0, (F.col("p_partkey") % 7) / 7.0
    df = table(spark, sf_dir, "part").select("p_partkey", *[F.array(x, 1 - x).alias(n) for n, x in (("m0", a), ("m1", b), ("m2", c))])
    out = ensembles.soft_vote(df, ["m0", "m1", "m2"], ["yes", "no"])
    return rounded(out.select("p_partkey", "prediction", F.col("probabilities")[0].alias("p_yes")), "p_yes")


def quality_data(spark, sf_dir):
    """Labelled documents with a few text measures."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        "doc_id",
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ")).cast("double").alias("n_words"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("n_digits"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality"),
    )


def quality_prepared(spark, sf_dir):
    return model_zoo.prepare_dataset(
        quality_data(spark, sf_dir), "quality", ["lang", "n_chars", "n_words", "n_lines", "n_digits"], "classification", ["doc_id"]
    )


@query("leaderboard")
def q_leaderboard(spark, sf_dir):
    return model_zoo.leaderboard(quality_prepared(spark, sf_dir), ["Dummy", "Logistic Regression", "Gaussian NB", "Decision Tree", "Random Forest"], k=3, trees=20)


@query("leaderboard_regression")
def q_leaderboard_regression(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", (F.col("l_extendedprice") / 1000 + F.col("l_quantity")).alias("price")
    )
    data = model_zoo.prepare_dataset(df, "price", ["l_quantity", "l_discount", "l_returnflag"], "regression", ["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"])
    return model_zoo.leaderboard(data, ["Dummy", "Ridge", "Lasso", "Decision Tree"], k=3)


@query("score_batch")
def q_score(spark, sf_dir):
    data = quality_prepared(spark, sf_dir)
    pre = model_zoo.fit_features(data.frame, data.numeric, data.categorical)
    fitted = LogisticRegression(featuresCol=model_zoo.FEATURES, labelCol=model_zoo.LABEL, regParam=0.01).fit(pre.transform(data.frame))
    model = model_zoo.PipelineModel(stages=[*pre.stages, fitted])
    return scoring.score_batch(data.frame, model, data.classes, ["doc_id"])


@query("bagging_oob")
def q_bagging(spark, sf_dir):
    # texts are measured once, not in every pass of every member
    df = cut_lineage(quality_data(spark, sf_dir)).withColumn("y", (F.col("quality") == "good").cast("double"))
    return ensembles.Bagging(estimators=5, depth=5).fit(df, ["n_chars", "n_words", "n_lines", "n_digits"], "y", ["doc_id"]).oob(df)


@query("boosting")
def q_boosting(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", ((F.col("p_size") > 25) != (F.col("p_retailprice") > 950)).cast("double").alias("y"))
    fit = ensembles.Samme(rounds=6, depth=2).fit(df, ["p_size", "p_retailprice"], "y")
    return fit.transform(df).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("stacking")
def q_stacking(spark, sf_dir):
    df = quality_data(spark, sf_dir).withColumn("y", (F.col("quality") == "good").cast("double"))
    folded = split.stratified_folds(df, "y", ["doc_id"], 3)
    members = {"logistic": LogisticRegression(regParam=0.01), "tree": DecisionTreeClassifier(maxDepth=4, seed=42)}
    meta, oof = ensembles.stack(folded, ["n_chars", "n_words", "n_lines", "n_digits"], "y", members)
    return meta.transform(oof).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


# neighbours and clusters


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


PAIRS = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
  d AS (SELECT a.id, b.id AS neighbour, a.label AS own, b.label, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM v a, v b WHERE a.id <> b.id)"""


@query(
    "pairwise_topk",
    f"""WITH {PAIRS} SELECT id, neighbour, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 5""",
)
def q_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(neighbours.nearest(v, v, 5, exclude_self=True), "distance")


@query(
    "knn_vote",
    f"""WITH {PAIRS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS r FROM d) WHERE r <= 3), c AS (SELECT id, label, count(*) AS n FROM t GROUP BY ALL)
    SELECT id, arg_min(label, (-n, label)) AS prediction FROM c GROUP BY id""",
)
def q_knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return neighbours.knn_vote(v, v, 3, exclude_self=True)


@query(
    "kernel_vote",
    f"""WITH {PAIRS}, s AS (SELECT id, label, sum(exp(-distance / 0.5)) AS t FROM d GROUP BY ALL) SELECT id, label, round(t / (sum(t) OVER (PARTITION BY id) + 1e-12), 6) AS p FROM s""",
)
def q_kernel(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(neighbours.kernel_vote(v, v, 0.5, exclude_self=True), "p")


@query(
    "silhouette_exact",
    f"""WITH {PAIRS}, m AS (SELECT id, own, label, avg(distance) AS m FROM d GROUP BY ALL), ab AS (SELECT id, own AS label, max(m) FILTER (label = own) AS a, min(m) FILTER (label <> own) AS b FROM m GROUP BY ALL)
    SELECT id, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM ab""",
)
def q_silhouette(spark, sf_dir):
    return rounded(neighbours.silhouette(vectors(spark, sf_dir)), "silhouette")


CENTRES = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
  u AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c, max(n) AS n FROM u GROUP BY label)"""
GAP = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(
    "kmeans_assign",
    f"""WITH {CENTRES}, d AS (SELECT id, c.label, {GAP.format(a='v.v', b='c.c')} AS d FROM v, c) SELECT id, arg_min(label, (d, label)) AS nearest, round(sqrt(min(d)), 6) AS distance FROM d GROUP BY id""",
)
def q_assign(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return rounded(clusters.assign(v, clusters.centroids(v, 64)), "distance")


@query(
    "cluster_internal",
    f"""WITH {CENTRES}, s AS (SELECT v.label, avg(sqrt({GAP.format(a='v.v', b='c.c')})) AS s, sum({GAP.format(a='v.v', b='c.c')}) AS ss FROM v JOIN c USING (label) GROUP BY v.label),
    r AS (SELECT a.label, max((sa.s + sb.s) / sqrt({GAP.format(a='a.c', b='b.c')})) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY a.label),
    g AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(range(1, 65)) AS i, unnest(v) AS x FROM v) GROUP BY i)),
    w AS (SELECT sum(n * {GAP.format(a='c.c', b='g.g')}) AS b, sum(n) AS n, count(*) AS k FROM c, g)
    SELECT round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round(b / (SELECT sum(ss) FROM s) * (n - k) / (k - 1), 5) AS calinski_harabasz, k::INTEGER AS clusters FROM w""",
)
def q_internal(spark, sf_dir):
    return rounded(rounded(clusters.internal_quality(vectors(spark, sf_dir), 64), "davies_bouldin"), "calinski_harabasz", digits=5)


@query(
    "cluster_external",
    """WITH j AS (SELECT event_type AS t, CASE WHEN event_id % 10 < 6 THEN event_type ELSE 'k' || (user_id % 4) END AS c, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
    a AS (SELECT sum(n) AS n FROM j GROUP BY t), b AS (SELECT sum(n) AS n FROM j GROUP BY c),
    q AS (SELECT (SELECT sum(n) FROM j) AS n, (SELECT sum(n * (n - 1) / 2) FROM j) AS pj, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
       (SELECT sum(n * ln(n)) FROM j) AS wj, (SELECT sum(n * ln(n)) FROM a) AS wa, (SELECT sum(n * ln(n)) FROM b) AS wb),
    m AS (SELECT *, (wj - wa - wb) / n + ln(n) AS mi, ln(n) - wa / n AS ha, ln(n) - wb / n AS hb, pa * pb / (n * (n - 1) / 2) AS ex FROM q)
    SELECT round((pj - ex) / ((pa + pb) / 2 - ex), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * mi / (ha + hb), 6) AS v_measure FROM m""",
)
def q_external(spark, sf_dir):
    e = F.col("event_type")
    df = table(spark, sf_dir, "events").select(
        e.alias("t"), F.when(F.col("event_id") % 10 < 6, e).otherwise(F.concat(F.lit("k"), (F.col("user_id") % 4).cast("string"))).alias("c")
    )
    return rounded(clusters.external_quality(df, "t", "c"), "ari", "nmi", "homogeneity", "completeness", "v_measure")


def scaled_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"), ((F.col("p_retailprice") % 100) / 100.0).alias("y"))


@query(
    "eps_core_points",
    """WITH p AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS x, (p_retailprice % 100) / 100.0::DOUBLE AS y FROM part)
    SELECT a.id, count(*) >= 12 AS core FROM p a JOIN p b ON b.x BETWEEN a.x - 0.035 AND a.x + 0.035 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.0333::DOUBLE GROUP BY a.id""",
)
def q_core(spark, sf_dir):
    return density.eps_core_points(scaled_parts(spark, sf_dir), "p_partkey", ["x", "y"], 0.0333, 12)


@query("dbscan")
def q_dbscan(spark, sf_dir):
    return density.dbscan(scaled_parts(spark, sf_dir), "p_partkey", ["x", "y"], 0.0333, 12)


def two_dims(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)])


@query("kmeans_sweep")
def q_kmeans(spark, sf_dir):
    df, names = _embedding_columns(spark, sf_dir)
    return clusters.cluster_analysis(df, names, "vec_id")


@query(
    "lloyd_round",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT m.model, c.id AS centre, c.v AS c FROM v c, (VALUES (0, 3), (1, 7), (2, 12)) AS m(model, k) WHERE c.id < m.k),
    a AS (SELECT model, v.id, centre, v, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c QUALIFY row_number() OVER (PARTITION BY model, v.id ORDER BY d, centre) = 1),
    e AS (SELECT model, centre, i, avg(x) AS x FROM (SELECT model, centre, unnest(range(64)) AS i, unnest(v) AS x FROM a) GROUP BY ALL)
    SELECT model, centre::INTEGER AS centre, n, round(total, 6) AS total, round(inertia, 4) AS inertia FROM (SELECT model, centre, count(*) AS n, sum(d) AS own FROM a GROUP BY ALL)
      JOIN (SELECT model, centre, sum(x * (i + 1)) AS total FROM e GROUP BY ALL) USING (model, centre) JOIN (SELECT model, sum(d) AS inertia FROM a GROUP BY model) USING (model)""",
)
def q_lloyd(spark, sf_dir):
    """One step of three models in one pass, from the first rows as centres."""
    points = vectors(spark, sf_dir).select("id", "v")
    first = [r["v"] for r in points.where("id < 12").orderBy("id").collect()]
    new, sizes, inertia = lloyd.lloyd_round(points, [np.array(first[:k]) for k in (3, 7, 12)])
    weight = np.arange(1, 65)
    rows = [(m, c, int(sizes[m][c]), float(centre @ weight), float(inertia[m])) for m, centres in enumerate(new) for c, centre in enumerate(centres) if sizes[m][c]]
    out = spark.createDataFrame(rows, "model int, centre int, n long, total double, inertia double")
    return rounded(rounded(out, "total"), "inertia", digits=4)


@query(
    "cluster_labels",
    "WITH t AS (SELECT c_custkey AS id, c_acctbal AS a, c_nationkey AS b FROM customer) SELECT id, true AS has_labels, 1.0::DOUBLE AS shares FROM t",
)
def q_cluster_labels(spark, sf_dir):
    """Every row has a label of K-means and of the mixture at the best k, and responsibilities that add up to one."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    _, labels = clusters.cluster_report(df, ["a", "b"], "c_custkey", 4, 3)
    total = F.aggregate("responsibilities", F.lit(0.0), lambda a, x: a + x)
    return labels.select("id", (F.col("kmeans").isNotNull() & F.col("mixture").isNotNull()).alias("has_labels"), F.round(total, 6).alias("shares"))


@query("mixture_criteria")
def q_mixture(spark, sf_dir):
    return clusters.mixture_criteria(two_dims(spark, sf_dir), ["e0", "e1"], [1, 2, 3])


@query("micro_linkage")
def q_linkage(spark, sf_dir):
    return clusters.micro_linkage(two_dims(spark, sf_dir), ["e0", "e1", "e2", "e3"], 30, 4)


@query("smote")
def q_smote(spark, sf_dir):
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"), "toxic"
    )
    return neighbours.smote(df, ["n_chars", "n_words"], "toxic", 1)


# projections


@query(
    "pca_scree",
    """WITH p AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem), s AS (SELECT covar_samp(a, a) AS aa, covar_samp(b, b) AS bb, covar_samp(a, b) AS ab FROM p),
    e AS (SELECT (aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab * ab) AS l1, (aa + bb) / 2 - sqrt(pow((aa - bb) / 2, 2) + ab * ab) AS l2 FROM s)
    SELECT 1 AS component, round(l1, 4) AS variance, round(l1 / (l1 + l2), 6) AS ratio, round(l1 / (l1 + l2), 6) AS cumulative FROM e UNION ALL SELECT 2, round(l2, 4), round(l2 / (l1 + l2), 6), 1.0 FROM e""",
)
def q_scree(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    return rounded(rounded(reduce.pca(df, ["a", "b"]).scree(spark), "variance", digits=4), "ratio", "cumulative")


@query("pca_embeddings")
def q_pca(spark, sf_dir):
    from plumbrule.core.moments import array_columns

    df = array_columns(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return reduce.reconstruction_by_k(df, [f"f{i}" for i in range(64)])


@query("lda_projection")
def q_lda(spark, sf_dir):
    names = [f"e{i}" for i in range(4)]
    df = two_dims(spark, sf_dir)
    return reduce.lda(df, names, "label", 2).transform(df, "ld").select("vec_id", "label", "ld1", "ld2")


@query("kernel_pca")
def q_kernel_pca(spark, sf_dir):
    df = two_dims(spark, sf_dir)
    names = ["e0", "e1", "e2", "e3"]
    return reduce.kernel_pca(df, names, reduce.landmark_rows(df, names, ["vec_id"], 100), 2, gamma=5.0).select("vec_id", "kpc")


ANOMALY = """e AS (SELECT l_orderkey, l_extendedprice / 1000 AS err, l_returnflag <> 'A' AS odd FROM lineitem), t AS (SELECT avg(err) + 1.5::DOUBLE * stddev_pop(err) AS th FROM e WHERE NOT odd),
  f AS (SELECT odd, err > th AS flagged, th FROM e, t)"""


@query(
    "anomaly_threshold",
    f"""WITH {ANOMALY}, c AS (SELECT max(th) AS th, count(*) FILTER (flagged AND odd) AS tp, count(*) FILTER (flagged AND NOT odd) AS fp, count(*) FILTER (NOT flagged AND odd) AS fn FROM f)
    SELECT round(th, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, tp + fp AS flagged FROM c""",
)
def q_anomaly(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("err"), (F.col("l_returnflag") != "A").alias("odd"))
    flagged = reduce.anomaly_flags(df, "err", ~F.col("odd"), 1.5)
    return rounded(reduce.anomaly_quality(flagged, F.col("odd")), "threshold", "precision", "recall", "f1")


@query("reconstruction_anomalies")
def q_reconstruction(spark, sf_dir):
    df = two_dims(spark, sf_dir)
    names = ["e0", "e1", "e2", "e3"]
    fit = reduce.pca(df.where(F.col("label") == 0), names, 2)
    flagged = reduce.anomaly_flags(reduce.reconstruction_error(df, fit), "error", F.col("label") == 0)
    return reduce.anomaly_quality(flagged, F.col("label") != 0)


# attributions


ATTR = """x AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice / 100 AS b, (p_partkey % 11)::DOUBLE AS c FROM part),
  m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM x),
  sh AS (SELECT id, unnest(['a', 'b', 'c']) AS feature, unnest([a, b, c]) AS value, unnest([0.5::DOUBLE * (a - ma), -1.25::DOUBLE * (b - mb), 2.0::DOUBLE * (c - mc)]) AS shap FROM x, m)"""


def attributions(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"), (F.col("p_partkey") % 11).cast("double").alias("c")
    )
    return explain.linear_attribution(df, "p_partkey", ["a", "b", "c"], [0.5, -1.25, 2.0])


@query("linear_attribution", f"WITH {ATTR} SELECT id, feature, round(value, 6) AS value, round(shap, 6) + 0.0 AS shap FROM sh")
def q_attribution(spark, sf_dir):
    return rounded(attributions(spark, sf_dir), "value", "shap")


@query("global_importance", f"WITH {ATTR} SELECT feature, round(avg(abs(shap)), 6) AS mean_abs_shap FROM sh GROUP BY feature")
def q_global(spark, sf_dir):
    return rounded(explain.global_importance(attributions(spark, sf_dir)), "mean_abs_shap")


@query(
    "class_importance",
    f"""WITH {ATTR}, t AS (SELECT sh.*, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS k FROM sh), c AS (SELECT feature, avg(abs(shap)) FILTER (k = 'even') AS e, avg(abs(shap)) FILTER (k = 'odd') AS o FROM t GROUP BY feature)
    SELECT feature, round((e + o) / 2, 6) AS mean_abs_shap, round(e, 6) AS mean_abs_shap_even, round(o, 6) AS mean_abs_shap_odd FROM c""",
)
def q_class_importance(spark, sf_dir):
    df = attributions(spark, sf_dir).withColumn("k", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return rounded(explain.global_importance(df, "k", ["even", "odd"]), "mean_abs_shap", "mean_abs_shap_even", "mean_abs_shap_odd")


@query(
    "compare_attributions",
    f"""WITH {ATTR}, li AS (SELECT id, feature, shap * 0.5 + (id % 5) - 2 AS lime FROM sh WHERE NOT (feature = 'c' AND id % 3 = 0)), s2 AS (SELECT * FROM sh WHERE NOT (feature = 'a' AND id % 4 = 0)),
    j AS (SELECT coalesce(s2.id, li.id) AS id, coalesce(s2.feature, li.feature) AS feature, shap, lime FROM s2 FULL JOIN li ON s2.id = li.id AND s2.feature = li.feature)
    SELECT id, feature, round(shap, 6) + 0.0 AS shap, round(lime, 6) + 0.0 AS lime, CASE WHEN shap IS NOT NULL AND lime IS NOT NULL THEN sign(shap) = sign(lime) END AS sign_agreement FROM j""",
)
def q_compare_attr(spark, sf_dir):
    a = attributions(spark, sf_dir)
    noisy = a.where(~((F.col("feature") == "c") & (F.col("id") % 3 == 0))).select("id", "feature", (F.col("shap") * 0.5 + F.col("id") % 5 - 2).alias("lime"))
    out = explain.compare_attributions(a.where(~((F.col("feature") == "a") & (F.col("id") % 4 == 0))), noisy)
    return rounded(out.select("id", "feature", "shap", "lime", "sign_agreement"), "shap", "lime")


@query(
    "top_contributors",
    f"""WITH {ATTR}, r AS (SELECT id, feature, shap, row_number() OVER (PARTITION BY id ORDER BY abs(shap) DESC, feature) AS rank FROM sh)
    SELECT id, feature, round(shap, 6) + 0.0 AS shap, rank::INTEGER AS rank, CASE WHEN rank <= 1 THEN 'strongest' ELSE 'weakest' END AS role FROM r WHERE rank = 1 OR rank = 3""",
)
def q_contributors(spark, sf_dir):
    return rounded(explain.top_contributors(attributions(spark, sf_dir), 1), "shap")


def product_score(df):
    return df.withColumn("score", F.col("p_size") * F.col("p_retailprice") / 1000 + F.col("p_size"))


@query("shapley_exact")
def q_shapley(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    back = explain.background_rows(df, ["p_partkey"], ["p_size", "p_retailprice"], 20)
    return explain.shapley(df, "p_partkey", ["p_size", "p_retailprice"], back, product_score)


def _embedding_columns(spark, sf_dir):
    from plumbrule.core.moments import array_columns

    names = [f"f{i}" for i in range(64)]
    return array_columns(table(spark, sf_dir, "embeddings"), "embedding", 64), names


@query(
    "shapley_linear",
    """WITH x AS (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
    b AS (SELECT i, avg(v) AS m FROM x WHERE id < 20 GROUP BY i)
    SELECT id, 'f' || i AS feature, round(v, 6) AS value, round(((i % 7) - 3) / 2.0::DOUBLE * (v - m), 6) + 0.0 AS shap FROM x JOIN b USING (i)""",
)
def q_shapley_linear(spark, sf_dir):
    """Sampled coalitions of 64 features; a linear score has a closed form to compare with."""
    df, names = _embedding_columns(spark, sf_dir)
    weights = np.array([((i % 7) - 3) / 2 for i in range(64)])
    back = [r.asDict() for r in df.where("vec_id < 20").orderBy("vec_id").select(*names).collect()]
    out = shapley.kernel_shapley(df, "vec_id", names, back, lambda x: x @ weights, 256)
    return rounded(out, "value", "shap")


@query("tree_shapley", "SELECT vec_id AS id, 64 AS n_features, 0.0::DOUBLE AS gap FROM embeddings")
def q_tree_shapley(spark, sf_dir):
    """Attributions of a forest over 64 features add up to its prediction less the mean prediction of the background."""
    from pyspark.ml.regression import RandomForestRegressor

    df, names = _embedding_columns(spark, sf_dir)
    x = df.withColumn("features", array_to_vector("embedding")).withColumn("label", F.col("label").cast("double"))
    model = RandomForestRegressor(numTrees=10, maxDepth=5, seed=3).fit(x)
    back = [r.asDict() for r in df.where("vec_id < 20").orderBy("vec_id").select(*names).collect()]
    found = shapley.tree_shapley(df, "vec_id", names, shapley.tree_leaves(model), back)
    predicted = model.transform(x).select(F.col("vec_id").alias("id"), "prediction")
    base = predicted.where("id < 20").agg(F.avg("prediction").alias("base")).first()["base"]
    sums = found.groupBy("id").agg(F.sum("shap").alias("total"), F.count("shap").cast("int").alias("n_features"))
    return sums.join(predicted, "id").select("id", "n_features", (F.round(F.col("total") + base - F.col("prediction"), 6) + 0.0).alias("gap"))


# trees grown level by level

LINE_X = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
FLAG_CODES = "li AS (SELECT l_quantity::DOUBLE AS f0, l_discount::DOUBLE AS f1, l_tax::DOUBLE AS f2, l_linenumber::DOUBLE AS f3, l_extendedprice AS price, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS y FROM lineitem)"


def flagged_lines(spark, sf_dir):
    flags = sorted(r[0] for r in table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().collect())
    code = F.array_position(F.array(*map(F.lit, flags)), F.col("l_returnflag")).cast("double") - 1
    x = array_to_vector(F.array(*[F.col(c).cast("double") for c in LINE_X]))
    return table(spark, sf_dir, "lineitem").select(x.alias("_features"), code.alias("y"), F.col("l_extendedprice").cast("double").alias("price"))


@query(
    "extra_trees_split",
    f"""WITH {FLAG_CODES}, e AS (UNPIVOT (SELECT (min(f0) + max(f0)) / 2 AS f0, (min(f1) + max(f1)) / 2 AS f1, (min(f2) + max(f2)) / 2 AS f2, (min(f3) + max(f3)) / 2 AS f3 FROM li) ON COLUMNS(*) INTO NAME f VALUE cut),
    x AS (SELECT y, price, unnest([{{'f': 'f0', 'v': f0}}, {{'f': 'f1', 'v': f1}}, {{'f': 'f2', 'v': f2}}, {{'f': 'f3', 'v': f3}}], recursive := true) FROM li),
    s AS (SELECT f, cut, y, price, v <= cut AS l FROM x JOIN e USING (f)),
    c AS (SELECT f, cut, l, y, count(*) AS k FROM s GROUP BY ALL), n AS (SELECT f, cut, l, sum(k) AS n, sum(k) - sum(k * k) / sum(k) AS loss FROM c GROUP BY ALL),
    r AS (SELECT f, sum(k) AS n, sum(k) - sum(k * k) / sum(k) AS loss FROM (SELECT f, y, sum(k) AS k FROM c GROUP BY ALL) GROUP BY f),
    g AS (SELECT 'classification' AS task, f, cut, (any_value(r.loss) - sum(n.loss)) / any_value(r.n) AS gain FROM n JOIN r USING (f) GROUP BY f, cut
      UNION ALL SELECT 'regression', f, cut, (SELECT var_pop(price) FROM li) - sum(w) / sum(k) FROM (SELECT f, cut, l, var_pop(price) * count(*) AS w, count(*) AS k FROM s GROUP BY ALL) GROUP BY f, cut)
    SELECT task, substr(f, 2)::INTEGER AS feature, round(cut, 6) AS threshold, round(gain, 3) AS gain FROM g QUALIFY row_number() OVER (PARTITION BY task ORDER BY gain DESC) = 1""",
)
def q_extra_trees(spark, sf_dir):
    """Root splits with the middle of every range as threshold, so that SQL can choose as well."""
    rows, out = flagged_lines(spark, sf_dir), []
    for task, label in (("classification", "y"), ("regression", "price")):
        learner = level_trees.ExtraTrees(task, 1, 1, len(LINE_X), label_col=label, draw=lambda tree, node, feature: np.full(np.shape(feature), 0.5))
        trees = learner.fit(rows).trees
        out.append((task, int(trees.feature[0, 0]), float(trees.threshold[0, 0]), learner.gains[0, 0]))
    out = spark.createDataFrame(out, "task string, feature int, threshold double, gain double")
    return rounded(rounded(out, "threshold"), "gain", digits=3)


@query(
    "boosting_round",
    f"""WITH {FLAG_CODES}, p AS (SELECT y AS c, count(*) / (SELECT count(*) FROM li) AS p FROM li GROUP BY y),
    x AS (SELECT y, unnest([{{'f': 0, 'v': f0}}, {{'f': 1, 'v': f1}}, {{'f': 2, 'v': f2}}, {{'f': 3, 'v': f3}}], recursive := true) FROM li),
    b AS (SELECT c, f, v, sum(p - (y = c)::INTEGER) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM x, p GROUP BY c, f, v),
    w AS (SELECT *, sum(g) OVER l AS gl, sum(h) OVER l AS hl, sum(n) OVER l AS nl, sum(g) OVER a AS ga, sum(h) OVER a AS ha, sum(n) OVER a AS na FROM b WINDOW l AS (PARTITION BY c, f ORDER BY v), a AS (PARTITION BY c, f)),
    s AS (SELECT *, gl * gl / hl + (ga - gl) * (ga - gl) / (ha - hl) - ga * ga / ha AS gain FROM w WHERE nl >= 20 AND na - nl >= 20)
    SELECT c::INTEGER AS class, f AS feature, v AS threshold, round(gain, 5) AS gain, round(-0.1 * gl / hl, 6) AS left_value, round(-0.1 * (ga - gl) / (ha - hl), 6) AS right_value
    FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY gain DESC, f, v) = 1""",
)
def q_boosting_round(spark, sf_dir):
    """The first round of softmax boosting with stumps: one tree a class."""
    learner = level_trees.HistogramBoosting(rounds=1, depth=1, label_col="y")
    model = learner.fit(flagged_lines(spark, sf_dir))
    value = model.trees.value
    out = [(t, f, cut, learner.gains[0][t, 0], float(value[t, 1, t]), float(value[t, 2, t])) for t, _, f, cut in model.splits()]
    out = spark.createDataFrame(out, "class int, feature int, threshold double, gain double, left_value double, right_value double")
    return rounded(rounded(out, "left_value", "right_value"), "gain", digits=5)


@query(
    "weighted_median",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_sort([{'v': l_quantity::DOUBLE, 'w': 0.5::DOUBLE}, {'v': l_extendedprice / 1000, 'w': 1.25}, {'v': l_discount * 100.0, 'w': 0.75}, {'v': 20.0::DOUBLE, 'w': 1.0}]) AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(s[list_min(list_filter([1, 2, 3, 4], lambda i: list_sum(list_transform(s[1:i], lambda x: x.w)) >= 1.75))].v, 6) AS prediction FROM m""",
)
def q_weighted_median(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_discount") * 100.0).alias("c"), F.lit(20.0).alias("d")
    )
    return rounded(df.withColumn("prediction", ensembles.weighted_median(["a", "b", "c", "d"], [0.5, 1.25, 0.75, 1.0])).drop("a", "b", "c", "d"), "prediction")


@query("lime_surrogate")
def q_lime(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    facts = prep.scale_facts(df, ["p_size", "p_retailprice"])
    return explain.lime(df, "p_partkey", ["p_size", "p_retailprice"], [facts["p_size"][1], facts["p_retailprice"][1]], product_score, samples=100)


@query("permutation_importance")
def q_permutation(spark, sf_dir):
    from plumbrule.operators.metrics import permutation_importance

    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") > 25).cast("int").alias("y"))
    score = lambda d: d.withColumn("prediction", (F.col("p_size") * 1.0 + F.col("p_retailprice") / 1000 > 26).cast("int"))
    return permutation_importance(df, ["p_size", "p_retailprice"], ["p_partkey"], score, F.avg((F.col("prediction") == F.col("y")).cast("double")), repeats=5)


# monitoring

DAYS = """ref AS (SELECT event_type AS v, count(*)::DOUBLE AS r FROM events WHERE ts < TIMESTAMP '2024-01-11' GROUP BY 1), nr AS (SELECT sum(r) AS n FROM ref),
 d AS (SELECT date_trunc('day', ts) AS w, event_type AS v, count(*)::DOUBLE AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY ALL), dw AS (SELECT w, sum(n) AS nn FROM d GROUP BY w),
 f AS (SELECT dw.w, v, r, coalesce((SELECT n FROM d WHERE d.w = dw.w AND d.v = ref.v), 0) AS n, nn, nr.n AS nr FROM dw, ref, nr),
 c AS (SELECT w, sum(pow(r - nr * (r + n) / (nr + nn), 2) / (nr * (r + n) / (nr + nn)) + pow(n - nn * (r + n) / (nr + nn), 2) / (nn * (r + n) / (nr + nn))) AS st, 0.5 * sum(abs(r / nr - n / nn)) AS tvd,
   min(least(nr * (r + n) / (nr + nn), nn * (r + n) / (nr + nn))) < 5 AS low, count(*) - 1 AS dof FROM f GROUP BY w)"""


@query(
    "events_drift_by_day",
    f"""WITH {DAYS} SELECT strftime(w, '%Y-%m-%d') AS day, round(st, 6) AS statistic, dof, round(exp(-st / 2) * (1 + st / 2), 6) AS p_value, exp(-st / 2) * (1 + st / 2) < 0.05 AS drifted,
    round(tvd, 6) AS total_variation_distance, low AS low_expected_counts FROM c""",
)
def q_drift_days(spark, sf_dir):
    import datetime

    events = table(spark, sf_dir, "events")
    cut = F.lit(datetime.datetime(2024, 1, 11))
    counts = monitor.windowed_counts(events.where(F.col("ts") >= cut), "ts", "event_type")
    out = monitor.drift_by_window(events.where(F.col("ts") < cut), counts, "event_type")
    out = out.withColumn("day", F.date_format("window_start", "yyyy-MM-dd")).drop("window_start")
    return rounded(out, "statistic", "p_value", "total_variation_distance")


@query("table_fingerprint")
def q_fingerprint(spark, sf_dir):
    from plumbrule.sources.tables import fingerprint

    return fingerprint(table(spark, sf_dir, "orders"))


@query(
    "row_digests",
    """SELECT r_regionkey, sha256(CAST(r_regionkey AS VARCHAR) || chr(31) || r_name) AS digest FROM region""",
)
def q_digests(spark, sf_dir):
    from plumbrule.sources.tables import row_digests

    return row_digests(table(spark, sf_dir, "region")).select("r_regionkey", "digest")


@query(
    "prediction_lines",
    """SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"class":"' || CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END || '"}' AS value FROM part""",
)
def q_lines(spark, sf_dir):
    from plumbrule.sources.tables import prediction_lines

    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("class"))
    return prediction_lines(df).select(F.get_json_object("value", "$.p_partkey").cast("bigint").alias("p_partkey"), "value")



PSI = "(-0.5772156649015329 + coalesce(list_sum(list_transform(range(1, {0}::BIGINT), lambda i: 1.0::DOUBLE / i)), 0))"


@query(
    "nearest_information",
    f"""WITH x AS (SELECT p_partkey AS id, p_type AS label, unnest([{{'f': 'p_size', 'v': p_size::DOUBLE}}, {{'f': 'price_cents', 'v': round(p_retailprice * 100)}}], recursive := true) FROM part),
    s AS (SELECT a.f, a.id, a.v, a.label, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.f, a.id ORDER BY abs(a.v - b.v)) AS rn, count(*) OVER (PARTITION BY a.f, a.id) AS others
          FROM x a JOIN x b ON a.f = b.f AND a.label = b.label AND a.id <> b.id),
    r AS (SELECT f, id, v, label, others, d AS r FROM s WHERE rn = least(3, others)),
    m AS (SELECT r.f, r.id, any_value(r.others) + 1 AS size, count(*) FILTER (abs(r.v - x.v) < r.r OR (r.r = 0 AND r.v = x.v)) AS m,
            CASE WHEN any_value(r.r) > 0 THEN least(3, any_value(r.others)) ELSE count(*) FILTER (r.v = x.v AND r.label = x.label) END AS k
          FROM r JOIN x ON r.f = x.f GROUP BY r.f, r.id)
    SELECT f AS feature, round(greatest({PSI.format('count(*)')} + avg({PSI.format('k')}) - avg({PSI.format('size')}) - avg({PSI.format('m')}), 0), 6) AS mutual_information FROM m GROUP BY f""",
)
def q_nearest_information(spark, sf_dir):
    from plumbrule.operators.association import nearest_information

    df = table(spark, sf_dir, "part").select("p_type", "p_size", F.round(F.col("p_retailprice") * 100).alias("price_cents"))
    return rounded(nearest_information(df, "p_type", ["p_size", "price_cents"]), "mutual_information")


@query("margin_classifier")
def q_margin(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_size", "p_retailprice", F.when(F.col("p_size") + F.col("p_retailprice") / 100 > 36, "up").otherwise("down").alias("side"))
    out = model_zoo.MarginClassifier(steps=50).fit(df, ["p_size", "p_retailprice"], "side").transform(df)
    near = F.abs(F.col("margin") - 1) <= 0.25
    return out.groupBy("side", "prediction").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("support_vectors"))


@query("learning_curve")
def q_learning_curve(spark, sf_dir):
    return model_zoo.learning_curve(quality_prepared(spark, sf_dir), ["Gaussian NB"], (0.25, 1.0), k=2)


@query("eps_sweep")
def q_eps_sweep(spark, sf_dir):
    df = scaled_parts(spark, sf_dir).withColumn("half", (F.col("x") > 0.5).cast("int"))
    return density.eps_sweep(df, "p_partkey", ["x", "y"], [0.02, 0.0333], 12, "half")
