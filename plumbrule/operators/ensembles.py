"""Bagging with out-of-bag scores, SAMME boosting, voting and stacking."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.core.session import cut_lineage
from plumbrule.functions.columns import argmax
from plumbrule.operators.model_zoo import FEATURES, LABEL
from plumbrule.operators.split import feature_subsets, member_weight

CUT_EVERY = 5


def assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    rows = df.withColumn(LABEL, F.col(quoted(label)).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="skip").transform(rows)


class Bagging:
    """Trees on hashed bootstrap weights and feature subsets; averaged probabilities or values."""

    def __init__(self, task: str = "classification", estimators: int = 10, rows: float = 1.0, features: float | int = 1.0, replace: bool = True, depth: int = 8, seed: int = 42):
        self.task, self.estimators, self.rows, self.share = task, estimators, rows, features
        self.replace, self.depth, self.seed = replace, depth, seed

    def fit(self, df: DataFrame, features: Sequence[str], label: str, key: Sequence[str]) -> Bagging:
        self.features, self.label, self.key = list(features), label, list(key)
        self.subsets = feature_subsets(self.features, self.estimators, self.share, self.seed)
        # every member reads its rows several times, so what they are made of is computed once
        rows = cut_lineage(df.select(*map(quoted, dict.fromkeys([*self.key, *self.features, label]))))
        self.models = []
        for i, names in enumerate(self.subsets):
            mine = assembled(rows.withColumn("weight", self._weight(i)).where("weight > 0"), names, label)
            kind = DecisionTreeClassifier if self.task == "classification" else DecisionTreeRegressor
            self.models.append(kind(featuresCol=FEATURES, labelCol=LABEL, weightCol="weight", maxDepth=self.depth, seed=self.seed + i).fit(mine))
        self.classes = max(getattr(m, "numClasses", 0) for m in self.models)
        return self

    def _weight(self, i: int) -> Column:
        return member_weight(self.key, F.lit(i), self.seed, self.replace, self.rows)

    def _member(self, df: DataFrame, i: int) -> DataFrame:
        out = self.models[i].transform(VectorAssembler(inputCols=self.subsets[i], outputCol=FEATURES, handleInvalid="keep").transform(df))
        if self.task == "regression":
            return out.withColumn(f"_m{i}", F.col("prediction")).drop("prediction", FEATURES)
        p = vector_to_array("probability")
        padded = F.concat(p, F.array_repeat(F.lit(0.0), F.lit(self.classes) - F.size(p)))
        return out.withColumn(f"_m{i}", padded).drop("prediction", "probability", "rawPrediction", FEATURES)

    def _all(self, df: DataFrame) -> DataFrame:
        for i in range(self.estimators):
            df = self._member(df, i)
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """Mean of the members as ``prediction`` (and ``probabilities``)."""
        out = self._all(df)
        cols = [F.col(f"_m{i}") for i in range(self.estimators)]
        out = self._combine(out, F.array(*cols), F.lit(float(self.estimators)))
        return out.drop(*[f"_m{i}" for i in range(self.estimators)])

    def _combine(self, df: DataFrame, members: Column, count: Column) -> DataFrame:
        if self.task == "regression":
            return df.withColumn("prediction", F.aggregate(members, F.lit(0.0), lambda a, v: a + v) / count)
        zero = F.array_repeat(F.lit(0.0), F.lit(self.classes))
        mean = F.aggregate(members, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        out = df.withColumn("probabilities", F.transform(mean, lambda v: v / count))
        return out.withColumn("prediction", argmax("probabilities").cast("double"))

    def oob(self, df: DataFrame) -> DataFrame:
        """Score of every row by the members that did not draw it (rows drawn by all drop out): one row."""
        if not self.replace and self.rows >= 1.0:
            return df.sparkSession.createDataFrame([(None, 0)], "oob_score double, rows long")
        # the weights are a function of the key, so a row tells itself which members may score it; a row without a key has none
        keyed = functools.reduce(Column.__and__, [F.col(quoted(c)).isNotNull() for c in self.key])
        free = F.array_compact(F.array(*[F.when(self._weight(i) == 0, i) for i in range(self.estimators)]))
        rows = self._all(df.where(keyed).withColumn("_free", free).where(F.size("_free") > 0))
        cols = [F.when(F.array_contains("_free", i), F.col(f"_m{i}")) for i in range(self.estimators)]
        scored = self._combine(rows, F.array_compact(F.array(*cols)), F.size("_free").cast("double"))
        y = F.col(quoted(self.label)).cast("double")
        if self.task == "classification":
            return scored.agg(F.avg((F.col("prediction") == y).cast("double")).alias("oob_score"), F.count(F.lit(1)).alias("rows"))
        e = y - F.col("prediction")
        return scored.agg((1 - F.avg(e * e) / F.var_pop(y)).alias("oob_score"), F.count(F.lit(1)).alias("rows"))

    def importances(self) -> dict[str, float]:
        total = dict.fromkeys(self.features, 0.0)
        for names, m in zip(self.subsets, self.models):
            for n, v in zip(names, m.featureImportances.toArray()):
                total[n] += float(v) / self.estimators
        return total


#: Fixed values that the weights of known models agree with: the largest error that counts as none, the weight of a
#: faultless round, and weight and error of the lone tree when no round beats guessing.
FAULTLESS = 1e-12
FAULTLESS_WEIGHT = 1e6
LONE_WEIGHT = 1.0
LONE_ERROR = 0.5


def round_weight(error: float, classes: int, rate: float) -> float | None:
    """Weight of a round by the multi-class exponential loss (Zhu and others, 2009); None if it does not beat guessing."""
    if error <= FAULTLESS:
        return rate * FAULTLESS_WEIGHT
    odds = (1 - error) / error * (classes - 1)
    return rate * math.log(odds) if odds > 1 else None


class Samme:
    """Multi-class boosting of weighted stumps; weights live in a column and lineage is cut now and then."""

    def __init__(self, rounds: int = 50, rate: float = 1.0, depth: int = 1, seed: int = 42):
        self.rounds, self.rate, self.depth, self.seed = rounds, rate, depth, seed

    def fit(self, df: DataFrame, features: Sequence[str] | None = None, label: str = LABEL) -> Samme:
        """Without ``features`` the table already holds the feature vector and the numeric label."""
        data = df.select(LABEL, FEATURES) if features is None else assembled(df, features, label).select(LABEL, FEATURES)
        facts = data.agg(F.count(F.lit(1)).alias("n"), (F.max(LABEL) + 1).alias("k"), F.count_distinct(LABEL).alias("seen")).first()
        if facts["seen"] < 2:
            raise ValueError("boosting needs two or more classes")
        k, self.features = int(facts["k"]), None if features is None else list(features)
        data = cut_lineage(data.withColumn("w", F.lit(1.0 / facts["n"])))
        self.classes, self.models, self.alphas, self.errors = k, [], [], []
        while len(self.models) < self.rounds:
            number = len(self.models)
            tree = DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol="w", maxDepth=self.depth, seed=self.seed + number).fit(data)
            scored = tree.transform(data).withColumn("bad", (F.col("prediction") != F.col(LABEL)).cast("double"))
            error = scored.agg((F.sum(F.col("w") * F.col("bad")) / F.sum("w")).alias("e")).first()["e"]
            weight = round_weight(error, k, self.rate)
            if weight is None:
                break
            faultless = error <= FAULTLESS
            self._add(tree, weight, 0.0 if faultless else error)
            if faultless:
                break
            # the sum of the new weights is known from the error, so no extra pass is needed to normalise
            total = (1 - error) + error * math.exp(weight)
            data = scored.select(LABEL, FEATURES, (F.col("w") * F.exp(weight * F.col("bad")) / total).alias("w"))
            if (number + 1) % CUT_EVERY == 0:
                data = cut_lineage(data)
        if not self.models:
            self._add(DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, maxDepth=self.depth).fit(data), LONE_WEIGHT, LONE_ERROR)
        return self

    def _add(self, model, alpha: float, error: float) -> None:
        self.models.append(model)
        self.alphas.append(float(alpha))
        self.errors.append(float(error))

    def votes(self, df: DataFrame) -> DataFrame:
        """One prediction column ``_v<i>`` per round."""
        out = df if self.features is None else VectorAssembler(inputCols=self.features, outputCol=FEATURES, handleInvalid="keep").transform(df)
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed("prediction", f"_v{i}").drop("probability", "rawPrediction")
        return out if self.features is None else out.drop(FEATURES)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [f"_v{i}" for i in range(len(self.models))]
        out = self.votes(df).withColumn("_s", vote_scores(cols, self.alphas, [float(c) for c in range(self.classes)]))
        return out.withColumn("prediction", argmax("_s").cast("double")).drop("_s", *cols)


class BoostedMedian:
    """Boosted regression trees by the errors of earlier rounds (AdaBoost.R2, Drucker 1997); the members' weighted median.

    The error of a row is its absolute error divided by the largest one of the round.  Trees learn from weighted
    rows, not from resampled ones, so a fit is the same on every run.  A round whose weighted error reaches one
    half ends the boosting and is dropped unless it is the first.
    """

    def __init__(self, rounds: int = 50, rate: float = 1.0, depth: int = 3, seed: int = 42):
        self.rounds, self.rate, self.depth, self.seed = rounds, rate, depth, seed

    def fit(self, df: DataFrame) -> BoostedMedian:
        data = cut_lineage(df.select(LABEL, FEATURES).withColumn("w", F.lit(1.0)))
        self.models, self.alphas, self.errors = [], [], []
        for number in range(self.rounds):
            tree = DecisionTreeRegressor(featuresCol=FEATURES, labelCol=LABEL, weightCol="w", maxDepth=self.depth, seed=self.seed + number).fit(data)
            scored = tree.transform(data).withColumn("e", F.abs(F.col("prediction") - F.col(LABEL)))
            facts = scored.agg(F.max("e").alias("top"), (F.sum(F.col("w") * F.col("e")) / F.sum("w")).alias("mean"), F.sum("w").alias("whole"), F.count(F.lit(1)).alias("n")).first()
            error = facts["mean"] / facts["top"] if facts["top"] else 0.0
            if error >= 0.5 and self.models:
                break
            self.models.append(tree)
            self.errors.append(float(error))
            if error <= 0 or error >= 0.5:
                self.alphas.append(1.0)
                break
            beta = error / (1 - error)
            self.alphas.append(self.rate * math.log(1 / beta))
            scale = facts["n"] / facts["whole"]
            data = scored.select(LABEL, FEATURES, (F.col("w") * scale * F.pow(F.lit(beta), self.rate * (1 - F.col("e") / facts["top"]))).alias("w"))
            if (number + 1) % CUT_EVERY == 0:
                data = cut_lineage(data)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out, names = df, [f"_v{i}" for i in range(len(self.models))]
        for name, m in zip(names, self.models):
            out = m.transform(out).withColumnRenamed("prediction", name)
        return out.withColumn("prediction", weighted_median(names, self.alphas)).drop(*names)


def weighted_median(columns: Sequence[str], weights: Sequence[float]) -> Column:
    """The smallest of the values at which the weights up to it reach half of all; NULL if a value is missing."""
    cells = F.array_sort(F.array(*[F.struct(F.col(quoted(c)).cast("double").alias("v"), F.lit(float(w)).alias("w")) for c, w in zip(columns, weights)]))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("v"))
    half = sum(map(float, weights)) / 2
    walk = lambda a, x: F.when(a["seen"] >= half, a).otherwise(F.struct((a["seen"] + x["w"]).alias("seen"), x["v"].alias("v")))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(quoted(c)).isNotNull()
    return F.when(whole, F.aggregate(cells, start, walk)["v"])


def vote_scores(columns: Sequence[str], weights: Sequence[float], classes: Sequence) -> Column:
    """Weighted votes per class as an array."""
    return F.array(*[sum((F.when(F.col(quoted(c)) == F.lit(k), float(w)).otherwise(0.0) for c, w in zip(columns, weights)), F.lit(0.0)) for k in classes])


def staged_votes(df: DataFrame, columns: Sequence[str], weights: Sequence[float], classes: Sequence, keep: Sequence[str]) -> DataFrame:
    """``round, prediction`` after every boosting round, long form; all inside one projection."""
    cells = [
        F.struct(F.lit(i + 1).alias("round"), F.get(F.array(*map(F.lit, classes)), argmax(vote_scores(columns[: i + 1], weights[: i + 1], classes))).alias("prediction"))
        for i in range(len(columns))
    ]
    return df.select(*map(quoted, keep), F.inline(F.array(*cells)))


def soft_vote(df: DataFrame, members: Sequence[str], classes: Sequence) -> DataFrame:
    """Mean of probability arrays and the class with the largest mean (first on a tie)."""
    k = float(len(members))
    mean = F.array(*[sum((F.col(quoted(m))[i] for m in members), F.lit(0.0)) / k for i in range(len(classes))])
    return df.withColumn("probabilities", mean).withColumn("prediction", F.get(F.array(*map(F.lit, classes)), argmax("probabilities")))


def stack(folded: DataFrame, features: Sequence[str], label: str, members: dict[str, object], fold: str = "fold", seed: int = 42):
    """Out-of-fold probabilities of the members as features of a logistic meta-model: (meta-model, table)."""
    data = assembled(folded, features, label)
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())
    parts = []
    for f in folds:
        out = data.where(F.col(fold) == f)
        for name, estimator in members.items():
            model = estimator.copy().setFeaturesCol(FEATURES).setLabelCol(LABEL).fit(data.where(F.col(fold) != f))
            out = model.transform(out).withColumnRenamed("probability", f"_p_{name}").drop("prediction", "rawPrediction")
        parts.append(out)
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    meta_in = VectorAssembler(inputCols=[f"_p_{n}" for n in members], outputCol="_meta").transform(table.drop(FEATURES))
    meta = LogisticRegression(featuresCol="_meta", labelCol=LABEL, maxIter=100).fit(meta_in)
    return meta, meta_in


