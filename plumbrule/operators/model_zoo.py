"""Preprocessing pipelines, model families of ``pyspark.ml``, cross-validation and leaderboards."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbrule.core.frames import as_double, field_types, is_numeric, quoted, require_columns, value_of
from plumbrule.core.ordering import medians
from plumbrule.core.session import cut_lineage
from plumbrule.operators import metrics
from plumbrule.operators.association import class_codes
from plumbrule.operators.level_trees import ExtraTrees, HistogramBoosting
from plumbrule.operators.neighbours import knn_mean, knn_vote
from plumbrule.operators.prep import fourier_features, impute_median, modes, scale_facts, standard_scale
from plumbrule.operators.profile import column_stats, suggest_features, task_type
from plumbrule.operators.split import learning_subsets, random_folds, random_split, stratified_folds, stratified_split

LABEL, FEATURES, FOLD = "_label", "_features", "fold"
MAX_CLASSES = 1_000
#: Rows of a partition that is read many times: its block is held, sent or turned into tree points by one task.
TASK_ROWS = 500_000


@dataclass
class PreparedData:
    """Lazy table with an encoded target and the column lists a model needs."""

    frame: DataFrame
    task: str
    target: str
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    key: list[str]
    classes: list[str] | None = None


def prepare_dataset(df: DataFrame, target: str, features: Sequence[str] | None = None, task: str | None = None, key: Sequence[str] = ()) -> PreparedData:
    """Check the target, choose usable features and add the numeric label.

    ``key`` names columns that identify a row; they order rows for splits (default: all columns).
    """
    require_columns(df, [target, *(features or []), *key])
    types = field_types(df)
    names = list(features) if features else [
        r["column"] for r in suggest_features(df.drop(*key), target).where("usable").collect()
    ]
    if not names:
        raise ValueError("no usable feature column")
    data = df.where(value_of(target, types[target]).isNotNull())
    if task is None:
        task = column_stats(data, [target]).select(task_type().alias("t")).first()["t"]
    numeric = [c for c in names if is_numeric(types[c])]
    keep = list(dict.fromkeys([*key, *names, target]))
    classes = None
    if task == "classification":
        codes = class_codes(data, target)
        counts = data.groupBy(F.col(quoted(target)).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        rows = codes.join(counts, "label").orderBy("code").limit(MAX_CLASSES + 1).collect()
        if len(rows) < 2:
            raise ValueError("classification needs two or more classes")
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        if min(r["n"] for r in rows) < 2:
            raise ValueError(f"a class of {target} has a single row")
        classes = [r["label"] for r in rows]
        lookup = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
        frame = data.select(*map(quoted, keep), lookup[F.col(quoted(target)).cast("string")].alias(LABEL))
    elif task == "regression":
        if not is_numeric(types[target]):
            raise ValueError("a regression target must be numeric")
        frame = data.select(*map(quoted, keep), as_double(target, types[target]).alias(LABEL))
    else:
        raise ValueError(f"unsupported task: {task}")
    return PreparedData(frame, task, target, names, numeric, [c for c in names if c not in numeric], list(key) or keep, classes)


def fit_features(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scale: bool = True) -> PipelineModel:
    """Median fill and standard scaling of numbers, mode fill and one-hot of text (unseen: all zeros).

    Everything learnt is written into ordinary pipeline stages, so the result saves and loads as one model.
    """
    fill = medians(train, numeric)
    mode = modes(train, categorical) if categorical else {}
    filled = impute_median(train, numeric, {c: fill.get(c, 0.0) for c in numeric}) if numeric else train
    facts = scale_facts(filled, numeric) if numeric else {}
    types = field_types(train)
    exprs = []
    for i, c in enumerate(numeric):
        m, s = facts[c] if scale else (0.0, 1.0)
        raw = f"nanvl(CAST({quoted(c)} AS DOUBLE), NULL)" if not is_bool(types[c]) else f"CAST(CAST({quoted(c)} AS INT) AS DOUBLE)"
        exprs.append(f"(coalesce({raw}, {float(fill.get(c, 0.0))!r}D) - {float(m)!r}D) / {float(s)!r}D AS _n{i}")
    for i, c in enumerate(categorical):
        text = str(mode.get(c) if mode.get(c) is not None else "").replace("\\", "\\\\").replace("'", "\\'")
        exprs.append(f"coalesce(CAST({quoted(c)} AS STRING), '{text}') AS _c{i}")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    k = len(categorical)
    if k:
        stages.append(StringIndexer(inputCols=[f"_c{i}" for i in range(k)], outputCols=[f"_i{i}" for i in range(k)], handleInvalid="keep", stringOrderType="alphabetAsc"))
        # the slot for unseen values is the last one and is dropped
        stages.append(OneHotEncoder(inputCols=[f"_i{i}" for i in range(k)], outputCols=[f"_h{i}" for i in range(k)], dropLast=True))
    stages.append(VectorAssembler(inputCols=[*[f"_n{i}" for i in range(len(numeric))], *[f"_h{i}" for i in range(k)]], outputCol=FEATURES))
    return Pipeline(stages=stages).fit(train)


def is_bool(dtype) -> bool:
    return dtype.simpleString() == "boolean"


COLS = {"featuresCol": FEATURES, "labelCol": LABEL}


class Majority:
    """Most frequent class, or the mean of a numeric target."""

    def __init__(self, task: str):
        self.task = task

    def fit(self, df: DataFrame):
        if self.task == "regression":
            value = df.agg(F.avg(LABEL)).first()[0]
        else:
            counts = df.groupBy(LABEL).count()
            value = counts.agg(F.min(F.struct((-F.col("count")).alias("k"), LABEL))[LABEL]).first()[0]
        return Constant(float(value))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value))


class NeighbourVote:
    """The k nearest training rows: their most frequent class, or the mean of a numeric target."""

    def __init__(self, task: str, k: int = 3):
        self.task, self.k = task, k

    def fit(self, df: DataFrame) -> NeighbourVote:
        kept = df.select(F.monotonically_increasing_id().alias("id"), vector_to_array(FEATURES).alias("v"), F.col(LABEL).alias("label"), F.col(LABEL).alias("y"))
        self.points = cut_lineage(kept)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        rows = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))
        asked = rows.select(F.col("_id").alias("id"), vector_to_array(FEATURES).alias("v"))
        found = knn_vote(asked, self.points, self.k) if self.task == "classification" else knn_mean(asked, self.points, self.k)
        return rows.join(found.select(F.col("id").alias("_id"), "prediction"), "_id", "left").drop("_id")


def classifiers(n_classes: int, rows: int, width: int, trees: int = 200, seed: int = 42) -> dict[str, object]:
    """Estimators of the classification families; penalties use this engine's 1/n loss scaling, ``trees`` scales all ensembles."""
    from plumbrule.operators.ensembles import Samme

    reg = 1.0 / max(rows, 1)
    gbt = GBTClassifier(maxIter=50, seed=seed, **COLS)
    return {
        "Dummy": Majority("classification"),
        "Logistic Regression": LogisticRegression(regParam=reg, standardization=False, family="multinomial", maxIter=200, **COLS),
        "Logistic One-vs-Rest": OneVsRest(classifier=LogisticRegression(regParam=reg, standardization=False, maxIter=100, **COLS), **COLS),
        "Linear SVM": OneVsRest(classifier=LinearSVC(regParam=reg, **COLS), **COLS) if n_classes > 2 else LinearSVC(regParam=reg, **COLS),
        "Gaussian NB": NaiveBayes(modelType="gaussian", **COLS),
        "Decision Tree": DecisionTreeClassifier(maxDepth=8, seed=seed, **COLS),
        "KNN": NeighbourVote("classification"),
        "Random Forest": RandomForestClassifier(numTrees=trees, maxDepth=10, seed=seed, **COLS),
        "Extra Trees": ExtraTrees(trees=max(1, trees // 2), seed=seed),
        "Histogram Boosting": HistogramBoosting(rounds=max(1, trees // 2)),
        "AdaBoost": Samme(rounds=max(1, trees // 4), seed=seed),
        "Gradient Boosting": OneVsRest(classifier=gbt, **COLS) if n_classes > 2 else gbt,
        "MLP": MultilayerPerceptronClassifier(layers=[width, 32, 16, n_classes], maxIter=200, seed=seed, **COLS),
    }


def regressors(rows: int, trees: int = 200, seed: int = 42) -> dict[str, object]:
    """Estimators of the regression families; ``trees`` scales all ensembles."""
    from plumbrule.operators.ensembles import BoostedMedian

    return {
        "Dummy": Majority("regression"),
        "Ridge": LinearRegression(regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, **COLS),
        "Lasso": LinearRegression(regParam=0.01, elasticNetParam=1.0, standardization=False, **COLS),
        "Huber": LinearRegression(loss="huber", regParam=1.0 / max(rows, 1), **COLS),
        "Decision Tree": DecisionTreeRegressor(maxDepth=8, seed=seed, **COLS),
        "KNN": NeighbourVote("regression"),
        "Random Forest": RandomForestRegressor(numTrees=trees, maxDepth=10, seed=seed, **COLS),
        "Extra Trees": ExtraTrees("regression", trees=max(1, trees // 2), seed=seed),
        "Histogram Boosting": HistogramBoosting("regression", rounds=max(1, trees // 2)),
        "AdaBoost": BoostedMedian(rounds=max(1, trees // 4), seed=seed),
        "Gradient Boosting": GBTRegressor(maxIter=100, seed=seed, **COLS),
    }


def evaluate(predicted: DataFrame, task: str) -> dict[str, float]:
    if task == "classification":
        r = metrics.classification_metrics(predicted, LABEL, "prediction").first()
        return {"accuracy": r["accuracy"], "f1_macro": r["f1_macro"]}
    r = metrics.regression_metrics(predicted, LABEL, "prediction").first()
    return {"r2": r["r2"], "mae": r["mae"]}


def _in_parallel(jobs: Sequence[Callable], width: int) -> list:
    """Run independent fits from a few driver threads; Spark schedules their tasks together."""
    if width <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=width) as pool:
        wrap = inheritable_thread_target(SparkSession.active())
        return [f.result() for f in [pool.submit(wrap(job)) for job in jobs]]


def _width(model: PipelineModel, df: DataFrame) -> int:
    return int(model.transform(df.limit(1)).select(F.size(vector_to_array(FEATURES))).first()[0])


def _on_disk(df: DataFrame) -> DataFrame:
    """The frame on the disks of the executors, whose memory is left to the fits; large partitions are dealt out anew."""
    rows = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    dealt = df.repartition(math.ceil(rows["n"] / TASK_ROWS)) if (rows["most"] or 0) > 2 * TASK_ROWS else df
    return dealt.persist(StorageLevel.DISK_ONLY)


def cross_validate(data: PreparedData, build: Callable[[int, int], dict[str, object]], k: int = 5, seed: int = 42, parallelism: int = 2, frame: DataFrame | None = None) -> DataFrame:
    """``model, fold, metric, value`` with the preprocessing fitted inside every fold."""
    base = frame if frame is not None else data.frame
    folded = stratified_folds(base, LABEL, data.key, k, seed) if data.task == "classification" else random_folds(base, data.key, k, seed)
    folded = _on_disk(folded.select(*map(quoted, dict.fromkeys([*data.numeric, *data.categorical])), LABEL, FOLD))
    rows, lock = [], threading.Lock()
    try:
        for fold in range(k):
            train, test = folded.where(F.col(FOLD) != fold), folded.where(F.col(FOLD) == fold)
            prep = fit_features(train, data.numeric, data.categorical)
            train_x = prep.transform(train).select(LABEL, FEATURES).persist(StorageLevel.DISK_ONLY)
            test_x = prep.transform(test).select(LABEL, FEATURES)
            try:
                models = build(train_x.count(), _width(prep, train))

                def run(name, estimator, train_x=train_x, test_x=test_x, fold=fold):
                    scores = evaluate(estimator.fit(train_x).transform(test_x), data.task)
                    with lock:
                        rows.extend((name, fold, m, float(v)) for m, v in scores.items())

                _in_parallel([lambda n=n, e=e: run(n, e) for n, e in models.items()], parallelism)
            finally:
                train_x.unpersist()
    finally:
        folded.unpersist()
    return base.sparkSession.createDataFrame(rows, "model string, fold int, metric string, value double")


def holdout(data: PreparedData, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    both = stratified_split(data.frame, LABEL, data.key, test_share, seed) if data.task == "classification" else random_split(data.frame, data.key, test_share, seed)
    return both.where(~F.col("is_test")).drop("is_test"), both.where("is_test").drop("is_test")


def leaderboard(data: PreparedData, names: Sequence[str] | None = None, k: int = 5, trees: int = 200, seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Cross-validation and holdout scores per model, best cross-validation score first.

    Models are chosen by their cross-validation score; the holdout only reports.
    """
    train, test = holdout(data, seed=seed)
    train = _on_disk(train)

    def build(rows: int, width: int) -> dict[str, object]:
        every = classifiers(len(data.classes), rows, width, trees, seed) if data.task == "classification" else regressors(rows, trees, seed)
        return {n: e for n, e in every.items() if names is None or n in names}

    try:
        folds = cross_validate(data, build, k, seed, parallelism, frame=train)
        prep = fit_features(train, data.numeric, data.categorical)
        train_x = prep.transform(train).select(LABEL, FEATURES).persist(StorageLevel.DISK_ONLY)
        test_x = prep.transform(test).select(LABEL, FEATURES)
        built = build(train_x.count(), _width(prep, train))
        scored = _in_parallel([lambda n=n, e=e: (n, evaluate(e.fit(train_x).transform(test_x), data.task)) for n, e in built.items()], parallelism)
        train_x.unpersist()
    finally:
        train.unpersist()
    main, second = ("accuracy", "f1_macro") if data.task == "classification" else ("r2", "mae")
    tested = folds.sparkSession.createDataFrame(
        [(n, float(s[main]), float(s[second])) for n, s in scored], f"model string, test_{main} double, test_{second} double"
    )
    cv = folds.groupBy("model").pivot("metric", [main, second]).agg(F.avg("value"))
    return (
        cv.withColumnsRenamed({main: f"cv_{main}", second: f"cv_{second}"}).join(tested, "model").orderBy(F.desc(f"cv_{main}"), "model")
    )


def train_best(data: PreparedData, names: Sequence[str] | None = None, k: int = 5, trees: int = 200, seed: int = 42) -> tuple[str, PipelineModel, DataFrame]:
    """Refit the model with the best mean cross-validation score on all rows: name, full pipeline, leaderboard."""
    board = leaderboard(data, [n for n in (names or []) if n != "Dummy"] or None, k, trees, seed)
    best = next(r["model"] for r in board.collect() if r["model"] != "Dummy")
    prep = fit_features(data.frame, data.numeric, data.categorical)
    x = prep.transform(data.frame)
    rows, width = data.frame.count(), _width(prep, data.frame)
    every = classifiers(len(data.classes), rows, width, trees, seed) if data.task == "classification" else regressors(rows, trees, seed)
    fitted = every[best].fit(x.select(LABEL, FEATURES))
    return best, PipelineModel(stages=[*prep.stages, fitted]), board


def serving_choice(board: DataFrame, score: str = "test_accuracy") -> DataFrame:
    """Name of the stored model with the highest score."""
    return board.agg(F.max_by("model", score).alias("model"), F.max(score).alias(score))


def grid_search(data: PreparedData, grid: Sequence[dict], make: Callable[..., object], k: int = 3, seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Mean score of every parameter setting, ranked."""
    labels = {f"{i}": setting for i, setting in enumerate(grid)}
    runs = cross_validate(data, lambda rows, width: {i: make(**s) for i, s in labels.items()}, k, seed, parallelism)
    main = "accuracy" if data.task == "classification" else "r2"
    text = F.create_map(*[x for i, s in labels.items() for x in (F.lit(i), F.lit(", ".join(f"{a}={b}" for a, b in s.items())))])
    mean = runs.where(F.col("metric") == main).groupBy("model").agg(F.avg("value").alias("mean_score"), F.stddev_pop("value").alias("std_score"))
    return mean.select(text[F.col("model")].alias("setting"), "mean_score", "std_score").withColumn(
        "rank", F.rank().over(Window.orderBy(F.desc("mean_score")))
    )


def feature_ablation(data: PreparedData, sets: dict[str, Sequence[str]], names: Sequence[str], k: int = 5, trees: int = 50, seed: int = 42) -> DataFrame:
    """Mean cross-validation score per feature set and model, with the difference to the first set."""
    main, out = ("accuracy" if data.task == "classification" else "r2"), None
    for label, cols in sets.items():
        part = PreparedData(data.frame, data.task, data.target, list(cols), [c for c in data.numeric if c in cols], [c for c in data.categorical if c in cols], data.key, data.classes)
        build = lambda rows, width: {n: e for n, e in (classifiers(len(data.classes), rows, width, trees, seed) if data.task == "classification" else regressors(rows, trees, seed)).items() if n in names}
        runs = cross_validate(part, build, k, seed).where(F.col("metric") == main).groupBy("model").agg(F.avg("value").alias("score")).withColumn("feature_set", F.lit(label))
        out = runs if out is None else out.unionByName(runs)
    first = next(iter(sets))
    base = F.max(F.when(F.col("feature_set") == first, F.col("score"))).over(Window.partitionBy("model"))
    return out.withColumn("delta", F.col("score") - base)


def split_stability(data: PreparedData, names: Sequence[str], seeds: Sequence[int], trees: int = 50) -> DataFrame:
    """Holdout score per split seed and model."""
    rows = []
    for seed in seeds:
        train, test = holdout(data, seed=seed)
        prep = fit_features(train, data.numeric, data.categorical)
        x = prep.transform(train).select(LABEL, FEATURES)
        n, width = x.count(), _width(prep, train)
        every = classifiers(len(data.classes), n, width, trees) if data.task == "classification" else regressors(n, trees)
        for name in names:
            scores = evaluate(every[name].fit(x).transform(prep.transform(test).select(LABEL, FEATURES)), data.task)
            rows.append((seed, name, float(scores["accuracy" if data.task == "classification" else "r2"])))
    return data.frame.sparkSession.createDataFrame(rows, "seed int, model string, score double")


def learning_curve(data: PreparedData, names: Sequence[str], fractions: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0), k: int = 5, trees: int = 50, seed: int = 42) -> DataFrame:
    """Score per model, fraction of the training rows and held-out fold; empty below 50 rows or 10 per class."""
    rows: list[tuple] = []
    schema = "model string, fraction double, fold int, n_train long, score double"
    counts = data.frame.groupBy(LABEL).count().agg(F.sum("count").alias("n"), F.min("count").alias("least")).first()
    spark = data.frame.sparkSession
    if (counts["n"] or 0) < 50 or (data.task == "classification" and counts["least"] < 10):
        return spark.createDataFrame(rows, schema)
    folded = stratified_folds(data.frame, LABEL, data.key, k, seed).persist(StorageLevel.MEMORY_AND_DISK)
    subsets = learning_subsets(folded, LABEL, data.key, fractions, k).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for fold in range(k):
            test = folded.where(F.col(FOLD) == fold)
            for f in fractions:
                train = subsets.where((F.col("held_out") == fold) & (F.col("fraction") == F.lit(float(f))))
                prep = fit_features(train, data.numeric, data.categorical)
                x, n = prep.transform(train).select(LABEL, FEATURES), train.count()
                every = classifiers(len(data.classes), n, _width(prep, train), trees, seed) if data.task == "classification" else regressors(n, trees, seed)
                for name in names:
                    scores = evaluate(every[name].fit(x).transform(prep.transform(test).select(LABEL, FEATURES)), data.task)
                    rows.append((name, float(f), fold, n, float(scores["accuracy" if data.task == "classification" else "r2"])))
    finally:
        subsets.unpersist()
        folded.unpersist()
    return spark.createDataFrame(rows, schema)


def compare_representations(tables: dict[str, tuple[DataFrame, Sequence[str]]], target: str, key: Sequence[str], name: str = "Logistic Regression", k: int = 5) -> DataFrame:
    """Mean cross-validation accuracy of one model on several representations of the same rows."""
    out = None
    for label, (df, features) in tables.items():
        data = prepare_dataset(df, target, list(features), "classification", key)
        runs = cross_validate(data, lambda rows, width, data=data: {name: classifiers(len(data.classes), rows, width)[name]}, k)
        row = runs.where(F.col("metric") == "accuracy").agg(F.lit(label).alias("representation"), F.avg("value").alias("accuracy"), F.stddev_pop("value").alias("std"))
        out = row if out is None else out.unionByName(row)
    return out


class MarginClassifier:
    """Two-class hinge-loss classifier on scaled columns, linear or on random Fourier features."""

    def __init__(self, penalty: float = 1.0, kernel: str = "linear", gamma: float = 1.0, components: int = 200, steps: int = 200, seed: int = 42):
        self.penalty, self.kernel, self.gamma, self.components, self.steps, self.seed = penalty, kernel, gamma, components, steps, seed

    def _inputs(self, df: DataFrame) -> DataFrame:
        scaled = standard_scale(df, self.features, self.facts)
        if self.kernel == "rbf":
            return fourier_features(scaled, self.features, self.components, self.gamma, self.seed, "_r").withColumn(FEATURES, array_to_vector("_r")).drop("_r")
        return scaled.withColumn(FEATURES, array_to_vector(F.array(*[F.col(quoted(c)).cast("double") for c in self.features])))

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> MarginClassifier:
        self.features, self.label, self.facts = list(features), label, scale_facts(df, features)
        self.classes = sorted(r[0] for r in df.select(quoted(label)).distinct().limit(3).collect())
        if len(self.classes) != 2:
            raise ValueError("a margin classifier needs exactly two classes")
        data = self._inputs(df).withColumn(LABEL, (F.col(quoted(label)) == F.lit(self.classes[1])).cast("double")).select(LABEL, FEATURES)
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.model = LinearSVC(regParam=1.0 / (self.penalty * max(data.count(), 1)), maxIter=self.steps, tol=1e-4, **COLS).fit(data)
        finally:
            data.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``margin`` (signed by the true class when the label is present)."""
        scored = self.model.transform(self._inputs(df))
        raw: Column = vector_to_array("rawPrediction")[1]
        sign = F.when(F.col(quoted(self.label)) == F.lit(self.classes[1]), 1.0).otherwise(-1.0) if self.label in df.columns else F.lit(1.0)
        picked = F.get(F.array(*map(F.lit, self.classes)), F.col("prediction").cast("int"))
        return scored.withColumns({"margin": raw * sign, "_c": picked}).drop("prediction", "rawPrediction", FEATURES).withColumnRenamed("_c", "prediction")

    def support_vectors(self, df: DataFrame, width: float = 0.25) -> DataFrame:
        """Rows whose margin is within ``width`` of 1."""
        return self.transform(df).where(F.abs(F.col("margin") - 1) <= width)
