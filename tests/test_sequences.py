"""Windows, conversations, sources and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbrule.operators import chatlog, clean, sequence
from plumbrule.sources import tables
from plumbrule.streaming import monitor


def test_windows_of_one_series(spark):
    df = spark.range(8).select(F.lit("s").alias("g"), F.col("id").alias("t"), (F.col("id") * 10.0).alias("v"))
    rows = {r["start"]: r for r in sequence.sliding_windows(df, ["g"], ["t"], "v", 3, 2).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert rows[1]["inputs"] == [10.0, 20.0, 30.0] and rows[1]["target"] == 50.0
    many = {r["start"]: r for r in sequence.multi_horizon(df, ["g"], ["t"], "v", 3, 2).collect()}
    assert many[3]["targets"] == [60.0, 70.0] and len(many) == 4


def test_forecast_continues_a_line(spark):
    df = spark.range(30).select(F.lit("s").alias("g"), F.col("id").alias("t"), (F.col("id") * 2.0 + 1).alias("v"))
    made = sequence.recursive_forecast(df, ["g"], ["t"], "v", [2.0, -1.0], 0.0, 3).first()["forecast"]
    assert made == [61.0, 63.0, 65.0]


def test_short_series_have_no_forecast(spark):
    df = spark.createDataFrame([("s", 1, 1.0)], "g string, t int, v double")
    assert sequence.recursive_forecast(df, ["g"], ["t"], "v", [1.0, 1.0], 0.0, 2).isEmpty()


@pytest.mark.parametrize(
    "question,expected",
    [
        ("Which target column should I use?", "target_selection"),
        ("Please compute the correlation", "computation"),
        ("Which variable matters?", "feature_importance"),
        ("Why?", "follow_up"),
        ("What does that mean?", "follow_up"),
        ("Is A better than B, compare them", "comparison"),
        ("Should I do that?", "recommendation"),
        ("Show the accuracy", "model_performance"),
        ("How many rows are there?", "dataset_stats"),
        ("Hello", "general"),
    ],
)
def test_question_types(spark, question, expected):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(chatlog.question_type(F.col("q"))).first()[0] == expected


def test_computation_after_an_answer(spark):
    df = spark.createDataFrame([("do it", "I could check leakage"), ("do it", "fine")], "q string, a string")
    got = [r[0] for r in df.select(chatlog.wants_computation(F.col("q"), F.col("a"))).collect()]
    assert got == [True, False]


def talk(spark, roles):
    rows = [(1, i, r, f"m{i}") for i, r in enumerate(roles)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def step_by_step(roles, limit):
    kept = []
    for i, r in enumerate(roles):
        kept.append((i, r))
        while len(kept) > limit:
            del kept[: 2 if kept[0][1] == "user" else 1]
    return [i for i, _ in kept]


@pytest.mark.parametrize("pattern", ["ua" * 6, "uuuuuuu", "uauuuuaaua", "aaaaaa", "suauauuu", "uu" + "ua" * 4 + "u"])
@pytest.mark.parametrize("turns", [1, 2, 3])
def test_trimming(spark, pattern, turns):
    roles = [{"u": "user", "a": "assistant", "s": "system"}[c] for c in pattern]
    got = sorted(r["turn"] for r in chatlog.trim_history(talk(spark, roles), turns).collect())
    assert got == step_by_step(roles, max(2 * turns, 2))


def test_pairs_use_up_questions(spark):
    df = talk(spark, ["user", "user", "assistant", "assistant", "user", "assistant"])
    good = F.col("turn").isin(3, 5)
    pairs = [(r["question_turn"], r["answer_turn"]) for r in chatlog.qa_pairs(df, good).collect()]
    assert pairs == [(4, 5)]
    kept = sorted((r["question_turn"], r["answer_turn"]) for r in chatlog.grounded_explanations(df, good).collect())
    assert kept == [(1, 3), (4, 5)]


def test_tokens_round_half_to_even(spark):
    df = spark.createDataFrame([("a b c d e",), ("",), (None,), ("  one\n two ",)], "t string")
    assert [r[0] for r in df.select(chatlog.estimated_tokens("t")).collect()] == [6, 0, 0, 3]


def test_even_sample_matches_even_positions(spark):
    df = spark.range(57).toDF("k")
    for size in (1, 2, 10, 56, 57, 80):
        got = sorted(r["k"] for r in clean.even_sample(df, ["k"], size).collect())
        want = sorted({j * 56 // max(size - 1, 1) for j in range(size)}) if size < 57 else list(range(57))
        assert got == (want if size > 1 else [0])


def test_clean_drops_rows_before_columns(spark):
    df = spark.createDataFrame([(1.0, None, None), (None, None, None), (float("nan"), "x", None)], "a double, b string, c string")
    out = clean.clean_dataframe(df)
    assert out.columns == ["a", "b"] and out.count() == 2


def test_constraints_treat_null_as_violation(spark):
    df = spark.createDataFrame([(5,), (-1,), (None,)], "x int")
    got = [r["valid"] for r in clean.check_rows(df, {"positive": F.col("x") > 0}).collect()]
    assert got == [True, False, False]


CSV = """Building Type,Square Footage,Number of Occupants,Appliances Used,Average Temperature,Day of Week,Energy Consumption
Residential,1000,0,5,20.5,Weekend,2000.0
Commercial,2000,10,20,21.5,Weekday,4000.0
Industrial,,10,20,21.5,Weekday,4000.0
"""


def test_building_table(spark, tmp_path):
    (tmp_path / "b.csv").write_text(CSV)
    path = str(tmp_path / "b.csv")
    assert tables.load_raw(spark, path).count() == 2
    feats = tables.load_features(spark, path, "extended")
    assert feats.columns[-1] == "label" and sorted(r["label"] for r in feats.collect()) == [0, 1]
    row = tables.building_features(tables.load_raw(spark, path, tables.building_schema())).where("is_weekend = 1").first()
    assert row["energy_per_sqft"] == 2.0 and row["appliance_per_occ"] == 5.0
    with pytest.raises(ValueError):
        tables.load_features(spark, path, "other")


def test_fingerprint_ignores_order_and_line_ends(spark):
    a = spark.createDataFrame([(1, "x\r\ny"), (2, "z")], "k int, s string")
    b = spark.createDataFrame([(2, "z"), (1, "x\ny")], "k int, s string")
    c = spark.createDataFrame([(2, "z"), (1, "x")], "k int, s string")
    assert tables.fingerprint(a).first() == tables.fingerprint(b).first() != tables.fingerprint(c).first()


def test_run_log_appends(spark, tmp_path):
    runs = spark.createDataFrame([("m", "accuracy", 0.5)], "model string, metric string, value double")
    tables.append_runs(runs, str(tmp_path / "runs"), "one")
    tables.append_runs(runs, str(tmp_path / "runs"), "two")
    assert sorted(r["run_id"] for r in tables.read_runs(spark, str(tmp_path / "runs")).collect()) == ["one", "two"]


def test_stream_scores_and_quarantines(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(i, float(i), float(i > 10)) for i in range(20)] + [(99, -5.0, 0.0)], "id long, x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="f"), LogisticRegression(featuresCol="f", labelCol="y")]).fit(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = monitor.score_stream(stream, model, ["no", "yes"], ["id"], {"x": F.col("x") >= 0}, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 20
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [99]


def test_stream_drift_equals_batch_drift(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=h), "ab"[h % 2] if h < 48 else "a") for h in range(96)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string")
    ref = df.where(F.col("ts") < F.lit(datetime.datetime(2024, 1, 3)))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = monitor.monitor_stream(stream, ref, "ts", "kind", lambda out, _e: seen.extend(out.collect()), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    batch = {r["window_start"]: r for r in monitor.drift_by_window(ref, monitor.windowed_counts(df, "ts", "kind"), "kind").collect()}
    assert seen and all(batch[r["window_start"]]["statistic"] == pytest.approx(r["statistic"]) for r in seen)
    assert not batch[start]["drifted"] and batch[datetime.datetime(2024, 1, 3)]["drifted"]
