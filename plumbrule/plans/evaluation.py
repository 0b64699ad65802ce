"""Metric, curve, diagnostic and report queries.

The predictions and scores that are evaluated are derived from the events and lineitem tables with plain
arithmetic, so that the SQL side can repeat them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbrule.operators import association, metrics, profile, reports
from plumbrule.plans.associations import RANK, RANK_CELLS, holed_lines, rounded
from plumbrule.plans.registry import query, table

PRED_SQL = """preds AS (SELECT event_id, event_type AS actual,
    CASE WHEN (event_id * 7) % 10 < 6 THEN event_type ELSE ['click', 'error', 'purchase', 'signup', 'view'][event_id % 5 + 1] END AS m1,
    CASE WHEN (event_id * 3) % 11 < 7 THEN event_type ELSE ['click', 'error', 'purchase', 'signup', 'view'][(event_id * 2) % 5 + 1] END AS m2,
    CASE WHEN user_id % 4 < 3 THEN event_type ELSE ['click', 'error', 'purchase', 'signup', 'view'][user_id % 5 + 1] END AS m3,
    ((event_id * 37) % 1000 + CASE WHEN event_type IN ('click', 'purchase') THEN 300 ELSE 0 END) / 1300.0::DOUBLE AS score,
    event_type IN ('click', 'purchase') AS positive, value FROM events)"""
TYPES = ["click", "error", "purchase", "signup", "view"]


def predictions(spark, sf_dir):
    e, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    names = F.array(*map(F.lit, TYPES))
    positive = t.isin("click", "purchase")
    return table(spark, sf_dir, "events").select(
        "event_id",
        t.alias("actual"),
        F.when((e * 7) % 10 < 6, t).otherwise(F.get(names, (e % 5).cast("int"))).alias("m1"),
        F.when((e * 3) % 11 < 7, t).otherwise(F.get(names, ((e * 2) % 5).cast("int"))).alias("m2"),
        F.when(u % 4 < 3, t).otherwise(F.get(names, (u % 5).cast("int"))).alias("m3"),
        (((e * 37) % 1000 + F.when(positive, 300).otherwise(0)) / 1300.0).alias("score"),
        positive.alias("positive"),
        "value",
    )


REPORT_SQL = """rep AS (SELECT c AS class, count(*) FILTER (actual = c AND m1 = c) AS tp, count(*) FILTER (actual <> c AND m1 = c) AS fp,
    count(*) FILTER (actual = c AND m1 <> c) AS fn FROM preds, (SELECT DISTINCT actual AS c FROM preds) GROUP BY c)"""


@query(
    "classification_metrics",
    f"""WITH {PRED_SQL}, {REPORT_SQL} SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(tp / (tp + fp)), 6) AS precision_macro,
    round(avg(tp / (tp + fn)), 6) AS recall_macro, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS f1_macro, CAST(sum(tp + fn) AS BIGINT) AS n FROM rep""",
)
def q_class_metrics(spark, sf_dir):
    out = metrics.classification_metrics(predictions(spark, sf_dir), "actual", "m1")
    return rounded(out, "accuracy", "precision_macro", "recall_macro", "f1_macro")


@query(
    "class_report",
    f"""WITH {PRED_SQL}, {REPORT_SQL} SELECT class, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
    round(2 * tp / (2 * tp + fp + fn), 6) AS f1, tp + fn AS support FROM rep""",
)
def q_report(spark, sf_dir):
    return rounded(metrics.class_report(predictions(spark, sf_dir), "actual", "m1"), "precision", "recall", "f1")


@query(
    "regression_metrics",
    """WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0::DOUBLE + l_linenumber * 10 AS p FROM lineitem)
    SELECT l_returnflag, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)) / 1e6, 4) AS mse_millions, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
    round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) + 0.0 AS r2, count(*) AS n FROM p GROUP BY 1""",
)
def q_reg_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0 + F.col("l_linenumber") * 10)
    out = metrics.regression_metrics(df, "l_extendedprice", "p", ["l_returnflag"]).withColumn("mse_millions", F.col("mse") / 1e6).drop("mse")
    return rounded(rounded(out, "mae", "mse_millions", "rmse", digits=4), "r2")


@query(
    "confusion_matrix",
    f"""WITH {PRED_SQL}, c AS (SELECT DISTINCT actual AS c FROM preds UNION SELECT DISTINCT m1 FROM preds)
    SELECT a.c AS actual, b.c AS predicted, (SELECT count(*) FROM preds WHERE actual = a.c AND m1 = b.c) AS n FROM c a, c b""",
)
def q_confusion(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir), "actual", "m1")


STEPS_SQL = """st AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT score, positive::INTEGER AS pos, (NOT positive)::INTEGER AS neg FROM preds) GROUP BY score),
  cu AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM st)"""


@query(
    "roc_auc",
    f"""WITH {PRED_SQL}, {STEPS_SQL} SELECT round(sum(neg * (cp - pos / 2.0)) / (max(p)::DOUBLE * max(n)), 6) AS auc, CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg FROM cu""",
)
def q_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(predictions(spark, sf_dir), "score", "positive"), "auc")


@query("roc_curve", f"WITH {PRED_SQL}, {STEPS_SQL} SELECT round(score, 6) AS threshold, round(cn / n, 6) AS fpr, round(cp / p, 6) AS tpr FROM cu")
def q_roc(spark, sf_dir):
    return rounded(metrics.roc_curve(predictions(spark, sf_dir), "score", "positive"), "threshold", "fpr", "tpr")


@query(
    "roc_auc_ovr",
    f"""WITH {PRED_SQL}, o AS (SELECT c, (c = actual) AS hit, (((event_id * 37) % 100) + CASE WHEN m1 = c THEN 40 ELSE 0 END) / 140.0::DOUBLE AS s FROM preds, (SELECT DISTINCT actual AS c FROM preds)),
    st AS (SELECT c, s, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM o GROUP BY ALL),
    cu AS (SELECT *, sum(pos) OVER (PARTITION BY c ORDER BY s DESC) AS cp, sum(pos) OVER (PARTITION BY c) AS p, sum(neg) OVER (PARTITION BY c) AS n FROM st)
    SELECT c AS class, round(sum(neg * (cp - pos / 2.0)) / (max(p)::DOUBLE * max(n)), 6) AS auc, CAST(max(p) AS BIGINT) AS n_pos, CAST(max(n) AS BIGINT) AS n_neg FROM cu GROUP BY c""",
)
def q_auc_ovr(spark, sf_dir):
    df = predictions(spark, sf_dir)
    base = (F.col("event_id") * 37) % 100
    df = df.withColumns({f"s_{c}": (base + F.when(F.col("m1") == c, 40).otherwise(0)) / 140.0 for c in TYPES})
    long = metrics.one_vs_rest(df, "actual", {c: f"s_{c}" for c in TYPES})
    return rounded(metrics.roc_auc(long, "score", "is_class", ["class"]), "auc")


@query(
    "pr_curve_ap",
    f"""WITH {PRED_SQL}, {STEPS_SQL} SELECT round(sum(pos / p * (cp / (cp + cn))), 6) AS average_precision FROM cu""",
)
def q_ap(spark, sf_dir):
    return rounded(metrics.average_precision(predictions(spark, sf_dir), "score", "positive"), "average_precision")


@query(
    "threshold_sweep",
    f"""WITH {PRED_SQL}, {STEPS_SQL}, x AS (SELECT score, cp / (cp + cn) AS pr, cp / p AS re FROM cu)
    SELECT round(score, 6) AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM x""",
)
def q_sweep(spark, sf_dir):
    return rounded(metrics.threshold_sweep(predictions(spark, sf_dir), "score", "positive"), "threshold", "precision", "recall", "f1")


@query(
    "calibration",
    f"""WITH {PRED_SQL} SELECT len(list_filter([0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]::DOUBLE[], lambda e: e < score))::INTEGER AS bin, round(avg(score), 6) AS mean_predicted,
    round(avg(positive::INTEGER), 6) AS fraction_positive, count(*) AS n FROM preds GROUP BY 1""",
)
def q_calibration(spark, sf_dir):
    return rounded(metrics.calibration_curve(predictions(spark, sf_dir), "score", "positive", 8), "mean_predicted", "fraction_positive")


def pair_sql(a, b):
    return f"""SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) FILTER ({a} = actual AND {b} = actual)::DOUBLE AS n11, count(*) FILTER ({a} <> actual AND {b} <> actual)::DOUBLE AS n00,
      count(*) FILTER ({a} = actual AND {b} <> actual)::DOUBLE AS n10, count(*) FILTER ({a} <> actual AND {b} = actual)::DOUBLE AS n01, count(*) FILTER ({a} <> {b})::DOUBLE AS dis, count(*) AS n FROM preds"""


@query(
    "ensemble_diversity",
    f"""WITH {PRED_SQL}, c AS ({pair_sql('m1', 'm2')} UNION ALL {pair_sql('m1', 'm3')} UNION ALL {pair_sql('m2', 'm3')})
    SELECT model_a, model_b, round(CASE WHEN n11 * n00 + n01 * n10 = 0 THEN 0 ELSE (n11 * n00 - n01 * n10) / (n11 * n00 + n01 * n10) END, 6) + 0.0 AS q_statistic,
    round(n00 / n, 6) AS double_fault, round(dis / n, 6) AS disagreement FROM c""",
)
def q_diversity(spark, sf_dir):
    out = metrics.ensemble_diversity(predictions(spark, sf_dir), "actual", ["m1", "m2", "m3"])
    return rounded(out, "q_statistic", "double_fault", "disagreement")


@query(
    "error_correlation",
    f"WITH {PRED_SQL} " + " UNION ALL ".join(
        f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(corr(({a} <> actual)::INTEGER, ({b} <> actual)::INTEGER), 6) + 0.0 AS correlation FROM preds"
        for a in ("m1", "m2", "m3") for b in ("m1", "m2", "m3")
    ),
)
def q_error_correlation(spark, sf_dir):
    return rounded(metrics.error_correlation(predictions(spark, sf_dir), "actual", ["m1", "m2", "m3"]), "correlation")


@query("greedy_selection")
def q_greedy(spark, sf_dir):
    return metrics.greedy_selection(predictions(spark, sf_dir), "actual", ["m1", "m2", "m3"], TYPES)


# Sixty groups of users stand for models: scores per fold come from the share of good events.
BOARD_SQL = """runs AS (SELECT CASE user_id % 6 WHEN 0 THEN 'Dummy baseline' WHEN 1 THEN 'Logistic Regression' WHEN 2 THEN 'KNN' WHEN 3 THEN 'Random Forest' WHEN 4 THEN 'MLP neural' ELSE 'Naive Bayes' END || ' ' || (user_id % 60) AS model,
    event_id % 5 AS fold, avg(CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score,
    avg(CASE WHEN event_type IN ('click', 'purchase') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS hits, avg(value) AS mv FROM events GROUP BY 1, 2),
  board AS (SELECT model, avg(score) AS cv_accuracy, avg(hits) + 0.2::DOUBLE AS test_accuracy, avg(mv) / 100 AS test_f1_macro FROM runs GROUP BY model)"""


def runs(spark, sf_dir):
    kinds = ["Dummy baseline", "Logistic Regression", "KNN", "Random Forest", "MLP neural", "Naive Bayes"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("user_id") % 6).cast("int"))
    good = F.col("event_type").isin("click", "purchase", "view").cast("double")
    hit = F.col("event_type").isin("click", "purchase").cast("double")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.concat_ws(" ", kind, F.col("user_id") % 60).alias("model"), (F.col("event_id") % 5).alias("fold"))
        .agg(F.avg(good).alias("score"), F.avg(hit).alias("hits"), F.avg("value").alias("mv"))
    )


def board(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("model").agg(
        F.avg("score").alias("cv_accuracy"), (F.avg("hits") + 0.2).alias("test_accuracy"), (F.avg("mv") / 100).alias("test_f1_macro")
    )


@query(
    "cv_summary",
    f"WITH {BOARD_SQL} SELECT model, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS low, round(max(score), 6) AS high, count(score) AS folds FROM runs GROUP BY model",
)
def q_cv_summary(spark, sf_dir):
    return rounded(metrics.cv_summary(runs(spark, sf_dir)), "mean", "std", "low", "high")


DIAG_SQL = """d AS (SELECT row_number() OVER (ORDER BY round(test_accuracy, 9) DESC, model) AS rank, model, round(test_accuracy, 9) AS test_metric, cv_accuracy AS cv_metric, cv_accuracy - round(test_accuracy, 9) AS cv_test_gap,
   max(round(test_accuracy, 9)) OVER () - round(test_accuracy, 9) AS gap_from_best, test_f1_macro AS secondary_metric, max(round(test_accuracy, 9)) OVER () - round(test_accuracy, 9) <= 0.01 AS near_best FROM board)"""


def stable_board(spark, sf_dir):
    return board(spark, sf_dir).withColumn("test_accuracy", F.round("test_accuracy", 9))


@query(
    "model_diagnostics",
    f"""WITH {BOARD_SQL}, {DIAG_SQL} SELECT rank::INTEGER AS rank, model, round(test_metric, 6) AS test_metric, round(cv_metric, 6) AS cv_metric, round(cv_test_gap, 6) + 0.0 AS cv_test_gap,
    round(gap_from_best, 6) AS gap_from_best, round(secondary_metric, 6) AS secondary_metric, near_best FROM d""",
)
def q_diagnostics(spark, sf_dir):
    out = reports.model_diagnostics(stable_board(spark, sf_dir))
    return rounded(out, "test_metric", "cv_metric", "cv_test_gap", "gap_from_best", "secondary_metric")


@query(
    "model_complexity",
    f"""WITH {BOARD_SQL} SELECT model, CASE WHEN model LIKE 'Dummy%' THEN 'Very low' WHEN model LIKE 'Logistic%' THEN 'Low' WHEN model LIKE 'KNN%' THEN 'Medium'
    WHEN model LIKE 'Random%' THEN 'High' WHEN model LIKE 'MLP%' THEN 'High' ELSE 'Medium' END AS complexity FROM board""",
)
def q_complexity(spark, sf_dir):
    return reports.model_complexity(board(spark, sf_dir))


@query(
    "overfit_verdict",
    f"""WITH {BOARD_SQL}, {DIAG_SQL} SELECT model, round(cv_test_gap, 6) + 0.0 AS cv_test_gap, CASE WHEN cv_test_gap > 0.1 THEN 'overfitting warning' WHEN cv_test_gap < -0.1 THEN 'unusually easy or small test split'
    WHEN abs(cv_test_gap) <= 0.05 THEN 'no strong signal' ELSE 'moderate gap' END AS verdict, test_metric >= 0.98 AND (SELECT count(*) FROM d WHERE near_best) > 1 AS near_perfect FROM d WHERE rank = 1""",
)
def q_overfit(spark, sf_dir):
    return rounded(reports.overfit_verdict(reports.model_diagnostics(stable_board(spark, sf_dir))), "cv_test_gap")


@query(
    "compare_feature_sets",
    f"""WITH {BOARD_SQL}, sb AS (SELECT model, round(test_accuracy, 9) AS t, test_f1_macro AS f FROM board),
    b AS ((SELECT 'all' AS feature_set, model, t, f FROM sb ORDER BY t DESC, model LIMIT 1) UNION ALL (SELECT 'compact', model, t * 0.75::DOUBLE, f FROM sb ORDER BY t DESC, model LIMIT 1))
    SELECT feature_set, model AS best_model, round(t, 6) AS primary_metric, round(f, 6) AS secondary_metric, round(max(t) OVER () - min(t) OVER (), 6) AS gap,
    max(t) OVER () - min(t) OVER () >= 0.15 AS large_gap, max(t) OVER () >= 0.98 AND max(t) OVER () - min(t) OVER () >= 0.15 AS suspicious FROM b""",
)
def q_compare(spark, sf_dir):
    full = stable_board(spark, sf_dir)
    out = reports.compare_feature_sets(full, full.withColumn("test_accuracy", F.col("test_accuracy") * 0.75))
    return rounded(out, "primary_metric", "secondary_metric", "gap")


@query(
    "normalize_results",
    f"""WITH {BOARD_SQL} SELECT model, round(cv_accuracy, 6) AS cv_score, round(test_accuracy, 6) AS test_score FROM board""",
)
def q_normalize(spark, sf_dir):
    named = board(spark, sf_dir).withColumnsRenamed({"model": "Model", "cv_accuracy": "CV Mean", "test_accuracy": "Test Acc"})
    return rounded(reports.normalize_results(named), "cv_score", "test_score")


@query(
    "report_facts",
    RANK + f""", {BOARD_SQL}, dup AS (SELECT count(*) AS c, sum((l_quantity IS NULL)::INTEGER + (flag_h IS NULL)::INTEGER) AS miss FROM li GROUP BY ALL),
    dd AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_extendedprice, l_discount, flag_h, count(*) AS c FROM li GROUP BY ALL)
    SELECT (SELECT CAST(sum(c) AS BIGINT) FROM dd) AS n_rows, 7 AS n_columns, (SELECT CAST(sum((l_quantity IS NULL)::INTEGER + (flag_h IS NULL)::INTEGER) AS BIGINT) FROM li) AS missing_cells,
      (SELECT CAST(sum(c - 1) AS BIGINT) FROM dd) AS duplicate_rows, (SELECT count(*) FROM board) AS n_models,
      (SELECT string_agg("column", ',' ORDER BY mi DESC, "column") FROM (SELECT * FROM mi ORDER BY mi DESC, "column" LIMIT 5)) AS top_features,
      (SELECT model FROM board ORDER BY round(cv_accuracy, 9) DESC, model LIMIT 1) AS best_model,
      (SELECT round(max(cv_accuracy), 6) FROM board) AS best_cv_score""",
)
def q_report_facts(spark, sf_dir):
    df = holed_lines(spark, sf_dir)
    ranking = association.feature_information(df, "l_returnflag", list(RANK_CELLS))
    results = board(spark, sf_dir).withColumn("cv_accuracy", F.round("cv_accuracy", 9))
    out = reports.report_facts(profile.profile_table(df), results, ranking)
    out = out.withColumn("top_features", F.array_join("top_features", ","))
    return rounded(out, "best_cv_score").drop("errors", "warnings", "best_test_score")


@query(
    "mesh_grid",
    """WITH e AS (SELECT min(p_size) - 1.0::DOUBLE AS x0, max(p_size) + 1.0::DOUBLE AS x1, min(p_retailprice) - 1.0 AS y0, max(p_retailprice) + 1.0 AS y1 FROM part)
    SELECT round(x0 + i * 0.5::DOUBLE, 6) AS p_size, round(y0 + j * 10.0::DOUBLE, 6) AS p_retailprice FROM e, range(0, 10000) AS a(i), range(0, 10000) AS b(j)
    WHERE i < ceil((x1 - x0) / 0.5) AND j < ceil((y1 - y0) / 10.0)""",
)
def q_mesh(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return rounded(reports.mesh_grid(df, "p_size", "p_retailprice", 0.5, 10.0), "p_size", "p_retailprice")
