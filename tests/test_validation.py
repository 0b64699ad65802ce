"""Rule tests on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from plumbrule.functions.significance import _regular_beta, _upper_gamma, chi2_sf
from plumbrule.operators import association, drift, profile, schema_rules


def rules(df, target=None):
    return {(r["severity"], r["column"], r["rule"]) for r in schema_rules.schema_issues(df, target).collect()}


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_clean_table_has_no_error(spark):
    rows = [(i, 20.0 + i * 0.5, f"r{i % 4}", ["A", "B", "C"][i % 3]) for i in range(90)]
    assert not any(s == "error" for s, _, _ in rules(table(spark, rows, "a long, b double, region string, target string"), "target"))


def test_empty_table(spark):
    found = rules(table(spark, [], "a string, b string, target string"), "target")
    assert ("error", None, "empty_table") in found
    assert not any(r == "single_class" for _, _, r in found)


def test_small_table(spark):
    rows = [(i, float(i), "x" if i % 2 else "y") for i in range(24)]
    found = rules(table(spark, rows, "a long, b double, target string"), "target")
    assert ("warning", None, "few_rows") in found
    assert ("info", "target", "low_cardinality") in found


@pytest.mark.parametrize("gaps,expected", [(40, ("error", "mostly_missing")), (12, ("warning", "many_missing")), (1, ("info", "some_missing")), (0, None)])
def test_missing_rates(spark, gaps, expected):
    rows = [(None if i < gaps else float(i), float(i % 7), f"t{i % 3}") for i in range(60)]
    found = {(s, r) for s, c, r in rules(table(spark, rows, "m double, u double, target string"), "target") if c == "m"}
    assert (expected in found) if expected else not found


def test_nan_is_missing(spark):
    df = table(spark, [(float("nan"),), (1.0,), (None,), (1.0,)], "x double")
    row = profile.column_stats(df).first()
    assert (row["missing"], row["distinct_values"]) == (2, 1)


def test_constant_and_single_class(spark):
    rows = [(5, float(i), "only") for i in range(60)]
    found = rules(table(spark, rows, "k long, u double, target string"), "target")
    assert ("warning", "k", "constant") in found
    assert ("error", "target", "single_class") in found
    assert ("warning", "target", "constant") not in found


def test_duplicates_count_null_as_equal(spark):
    df = table(spark, [(None, "a"), (None, "a"), (1.0, "a"), (float("nan"), "a")], "x double, y string")
    assert profile.duplicate_rows(df).first()["duplicate_rows"] == 2


def test_identifier(spark):
    rows = [(f"id{i}", float(i % 5), f"t{i % 3}") for i in range(90)]
    assert ("warning", "rid", "identifier_like") in rules(table(spark, rows, "rid string, u double, target string"), "target")


def test_extreme_value_needs_enough_rows(spark):
    few = [(1000.0 if i == 0 else float(i % 2), "t") for i in range(90)]
    many = [(100000.0 if i == 0 else float(i % 2), "t") for i in range(200)]
    assert not any(r == "extreme_value" for _, _, r in rules(table(spark, few, "x double, t string")))
    assert ("warning", "x", "extreme_value") in rules(table(spark, many, "x double, t string"))


def test_numeric_target(spark):
    rows = [(float(i), i * 1.5) for i in range(90)]
    assert ("info", "y", "numeric_target") in rules(table(spark, rows, "x double, y double"), "y")


def test_absent_target_and_few_columns(spark):
    found = rules(table(spark, [(1,)] * 40, "a long"), "gone")
    assert {("error", "gone", "target_absent"), ("error", None, "few_columns")} <= found


def test_coverage(spark):
    df = table(spark, [(1,)], "a long")
    assert [r["column"] for r in schema_rules.coverage_issues(df, ["a", "b"]).collect()] == ["b"]
    assert schema_rules.coverage_issues(df, ["a"]).isEmpty()


def test_summary(spark):
    df = table(spark, [(i, float(i), "x") for i in range(40)], "a long, b double, target string")
    row = schema_rules.issue_summary(schema_rules.schema_issues(df, "target")).first()
    assert not row["passed"] and row["errors"] == 1


@pytest.mark.parametrize(
    "values,valid,reason",
    [
        ([str(i) for i in range(0)], False, "no values"),
        (["a"] * 20, False, "fewer than two classes"),
        (["a"] * 20 + ["b"], False, "class with a single row"),
        (["a"] * 20 + ["b"] * 6, False, "smallest class too small for the folds"),
        (["a", "b", "c"] * 20, True, None),
        ([f"c{i}" for i in range(11)] * 8, False, "too many classes"),
    ],
)
def test_target_limits(spark, values, valid, reason):
    row = profile.validate_targets(spark.createDataFrame([(v,) for v in values], "t string")).first()
    assert (row["valid"], row["reason"]) == (valid, reason)


def test_continuous_target(spark):
    row = profile.validate_targets(spark.range(1000).toDF("t")).first()
    assert row["reason"] == "continuous" and row["appears_continuous"]


def test_target_ranking(spark):
    rows = [(i, ["N", "S", "W"][i % 3], ["R", "C", "I"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "`Energy Consumption` long, Region string, `Building Type` string")
    assert [r["column"] for r in profile.recommend_targets(df).collect()] == ["Building Type", "Region"]


def test_suggested_target(spark):
    rows = [(1, "a", "R"), (2, "b", "C"), (3, "a", "R"), (4, "b", "C")]
    df = spark.createDataFrame(rows, "feature_a long, feature_b string, `Building Type` string")
    assert profile.suggest_targets(df).first()["column"] == "Building Type"


def test_boolean_counts_as_number(spark):
    df = spark.createDataFrame([(bool(i % 2),) for i in range(100)], "flag boolean")
    assert profile.guess_task_types(df).first()["task_type"] == "classification"


def normals(spark, mean, seed, n=200):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.gauss(mean, 1),) for _ in range(n)], "x double")


def test_shifted_numbers_drift(spark):
    row = drift.drift_report(normals(spark, 0, 1), normals(spark, 10, 2)).first()
    assert row["drifted"] and row["statistic"] == pytest.approx(1.0)


def test_same_numbers_do_not_drift(spark):
    df = normals(spark, 0, 1)
    row = drift.drift_report(df, df).first()
    assert not row["drifted"] and row["statistic"] == 0.0 and row["p_value"] == 1.0


def test_empty_side_is_not_drift(spark):
    row = drift.drift_report(normals(spark, 0, 1), normals(spark, 0, 1).where("x > 99")).first()
    assert not row["drifted"] and row["statistic"] is None and row["new_mean"] is None


def letters(spark, a, b):
    return spark.createDataFrame([("a",)] * a + [("b",)] * b, "x string")


def test_category_swap_drifts(spark):
    row = drift.drift_report(letters(spark, 90, 10), letters(spark, 10, 90)).first()
    assert row["drifted"] and row["total_variation_distance"] == pytest.approx(0.8)
    # 2x2 table with continuity correction
    assert row["statistic"] == pytest.approx(200 * (abs(90 * 90 - 10 * 10) - 100) ** 2 / 100**4)


def test_missing_is_a_category(spark):
    ref = spark.createDataFrame([("a",)] * 50 + [(None,)] * 50, "x string")
    row = drift.drift_report(ref, letters(spark, 100, 0)).first()
    assert row["total_variation_distance"] == pytest.approx(0.5)


def test_changed_columns(spark):
    ref, new = spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1, 2)], "a long, c long")
    found = {(r["severity"], r["column"]) for r in drift.drift_issues(ref, new).collect()}
    assert {("error", "b"), ("warning", "c")} <= found


def test_alpha_is_checked(spark):
    with pytest.raises(ValueError):
        drift.drift_report(letters(spark, 1, 1), letters(spark, 1, 1), alpha=1.5)


def scores(df, target="target", task="classification"):
    return {r["column"]: r["score"] for r in association.leakage_scores(df, target, task).collect()}


def test_copy_is_leakage(spark):
    df = spark.createDataFrame([("ab"[i % 2],) * 2 for i in range(100)], "feature string, target string")
    assert scores(df) == {"feature": 1.0}


def test_copy_of_many_classes_is_leakage(spark):
    df = spark.createDataFrame([(f"c{i:02d}",) * 2 for i in range(60)], "copy string, target string")
    assert scores(df) == {"copy": 1.0}


def test_identifier_is_not_leakage(spark):
    df = spark.createDataFrame([(f"id{(i * 37) % 120:03d}", "abc"[i % 3]) for i in range(120)], "record_id string, target string")
    assert scores(df) == {"record_id": 0.0}


def test_noise_is_not_leakage(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.gauss(0, 1), i % 2) for i in range(400)], "noise double, target long")
    assert scores(df)["noise"] < 0.2


def test_imperfect_proxy_stays_below_the_limit(spark):
    # 108 of 120 rows agree, misses on both sides: normalised information 0.531
    rows = [("xy"[(i % 2) ^ (i % 20 < 2)], "pq"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "proxy string, target string")
    assert scores(df)["proxy"] == pytest.approx(0.531, abs=1e-3)
    assert association.leakage_issues(df, "target", "classification").isEmpty()


def test_regression_scores(spark):
    rows = [(float(i), i * 2.0 + 1, "ab"[i % 2], float((i * 7) % 11)) for i in range(60)]
    found = scores(spark.createDataFrame(rows, "copy double, target double, letter string, mixed double"), task="regression")
    assert found["copy"] == 1.0 and found["letter"] < 0.1 and found["mixed"] < 0.5


def test_one_class_scores_zero(spark):
    assert scores(spark.createDataFrame([(1, "a"), (2, "a")], "x long, target string")) == {"x": 0.0}


def test_complete_validation_covers_all_categories(spark):
    new = spark.createDataFrame([(i % 2, i % 2) for i in range(100)], "identity long, target long")
    ref = spark.createDataFrame([(0 if i < 90 else 1, i % 2) for i in range(100)], "identity long, target long")
    found = association.complete_validation(new, "target", "classification", ref)
    assert {r["category"] for r in found.collect()} == {"schema", "leakage", "drift"}
    assert [r["severity"] for r in found.collect()][0] == "error"


def test_tail_probabilities(spark):
    assert _upper_gamma(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert _upper_gamma(5, 18.307038 / 2) == pytest.approx(0.05, abs=1e-6)
    # P(F(3, 10) > 3.708) = 0.05
    assert _regular_beta(5, 1.5, 10 / (10 + 3 * 3.70826)) == pytest.approx(0.05, abs=1e-4)
    row = spark.createDataFrame([(9.487729, 4)], "x double, k long").select(chi2_sf("x", "k").alias("p")).first()
    assert row["p"] == pytest.approx(0.05, abs=1e-6)


def test_recommendation_words(spark):
    rows = [(i, (i * 7) % 9, ["a", "b", "c"][i // 3]) for i in range(9)] * 5
    out = association.recommend_features(spark.createDataFrame(rows, "signal long, weak_noise long, target string"), "target", ["signal", "weak_noise"])
    first = out.first()
    assert first["feature"] in ("signal", "weak_noise") and first["recommendation"] == "Strong"
    assert out.where(F.col("quality_score") > 1.0 + 1e-9).isEmpty()
