"""Shapley values for any number of features: sampled coalitions inside the row's task, and paths of trees.

A score here is a function of a matrix.  Every row meets the coalitions and the background inside its own task,
in pieces of bounded size, so nothing is exploded or shuffled.  The coalitions are the same for all rows:
small and large ones are listed in full as far as the budget goes, the rest are drawn with their complements
from a seed.  The weighted least squares for all rows then is one matrix, solved once on the driver.

For tree models the score is a sum over leaves.  A leaf is a product over the features on its path of "the row
passes" or, for features outside the coalition, "the background passes" (or the share of training rows that
do).  Shapley values of such a product follow from the coefficients of a polynomial of that length.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.core.session import shared_folder

#: Numbers in one piece of rows handed to a score.
PIECE = 4_000_000
MatrixScore = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Coalitions:
    """``masks`` (coalitions x features) and the map from coalition values to attributions."""

    masks: np.ndarray
    solve: np.ndarray  #: features x coalitions, applied to values less the base value
    spread: np.ndarray  #: how the total is shared where the coalitions leave it open


def _kernel_weight(d: int, size: int) -> float:
    """Weight of all coalitions of one size together."""
    return (d - 1) / (size * (d - size))


def coalitions(d: int, budget: int | None = None, seed: int = 42) -> Coalitions:
    """Coalitions of ``d`` features for at most ``budget`` (2 d + 2048) masks; all of them where that is enough."""
    budget = budget or 2 * d + 2048
    if d == 1:
        return Coalitions(np.zeros((0, 1), bool), np.zeros((1, 0)), np.ones(1))
    masks, weights, left = [], [], budget
    sizes = list(range(1, d // 2 + 1))
    while sizes:
        size = sizes[0]
        pair = 1 if 2 * size == d else 2
        count = pair * math.comb(d, size)
        if count > left:
            break
        for inside in itertools.combinations(range(d), size):
            mask = np.zeros(d, bool)
            mask[list(inside)] = True
            for m in (mask, ~mask)[:pair]:
                masks.append(m)
                weights.append(_kernel_weight(d, size) / math.comb(d, size))
        left -= count
        sizes.pop(0)
    if sizes and left >= 2:
        rng = np.random.default_rng(seed)
        shares = np.array([_kernel_weight(d, s) * (1 if 2 * s == d else 2) for s in sizes])
        drawn = rng.choice(sizes, left // 2, p=shares / shares.sum())
        for size in drawn:
            mask = np.zeros(d, bool)
            mask[rng.permutation(d)[:size]] = True
            for m in (mask, ~mask):
                masks.append(m)
                weights.append(shares.sum() / (2 * len(drawn)))
    z, w = np.array(masks, float), np.array(weights)
    normal = np.linalg.pinv((z * w[:, None]).T @ z)
    one = normal.sum(axis=1)
    spread = one / one.sum()
    # least squares under the condition that the attributions add up to the whole difference
    solve = normal @ (z * w[:, None]).T
    return Coalitions(z.astype(bool), solve - spread[:, None] * solve.sum(axis=0)[None, :], spread)


def _coalition_values(x: np.ndarray, background: np.ndarray, masks: np.ndarray, score: MatrixScore) -> np.ndarray:
    """Mean score of every coalition: its features from the row, the others from each background row."""
    d, size = x.shape[0], len(background)
    out = np.empty(len(masks))
    step = max(1, PIECE // (size * d))
    for at in range(0, len(masks), step):
        some = masks[at : at + step]
        mixed = np.where(some[:, None, :], x[None, None, :], background[None, :, :])
        out[at : at + step] = score(mixed.reshape(-1, d)).reshape(len(some), size).mean(axis=1)
    return out


def _per_row(rows: DataFrame, key: str, features: Sequence[str], values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``id, feature, value, shap`` from a function of the feature matrix; rows with a missing feature get NULL."""
    names = list(features)
    wide = rows.select(F.col(quoted(key)).alias("id"), F.array(*[F.col(quoted(f)).cast("double") for f in names]).alias("v"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.array(batch["v"].tolist(), float)
            whole = np.isfinite(x).all(axis=1)
            found = iter(values(x[whole]) if whole.any() else ())
            yield batch.assign(shap=[next(found) if ok else None for ok in whole])

    kind = wide.schema["id"].dataType.simpleString()
    out = wide.mapInPandas(work, f"id {kind}, v array<double>, shap array<double>")
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("v")[i].alias("value"), F.get("shap", F.lit(i)).alias("shap")) for i, f in enumerate(names)])
    return out.select("id", F.inline(cells))


def kernel_shapley(rows: DataFrame, key: str, features: Sequence[str], background: Sequence[dict], score: MatrixScore, budget: int | None = None, seed: int = 42) -> DataFrame:
    """``id, feature, value, shap`` of a matrix score; exact where the budget holds all coalitions (about eleven features).

    The attributions of a row always add up to its score less the mean score of the background.
    """
    back = np.array([[float(b[f]) for f in features] for b in background])
    plan = coalitions(len(features), budget, seed)

    def values(x: np.ndarray) -> np.ndarray:
        base, own = float(score(back).mean()), score(x)
        out = np.empty(x.shape)
        for i, row in enumerate(x):
            out[i] = plan.solve @ (_coalition_values(row, back, plan.masks, score) - base) + plan.spread * (own[i] - base)
        return out

    return _per_row(rows, key, features, values)


@dataclass(frozen=True)
class Leaf:
    """A leaf with the features on its path: the interval each must lie in, or the categories that pass."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    allowed: tuple[tuple | None, ...]
    share: tuple[float, ...]  #: share of the training rows before the splits on the feature that pass them

    def passes(self, x: np.ndarray) -> np.ndarray:
        """rows x features of the path."""
        out = np.empty((len(x), len(self.features)), bool)
        for j, (f, low, high, allowed) in enumerate(zip(self.features, self.low, self.high, self.allowed)):
            out[:, j] = (x[:, f] > low) & (x[:, f] <= high)
            if allowed is not None:
                out[:, j] &= np.isin(x[:, f], allowed)
        return out


def _leaves(nodes: dict, scale: float, pick: Callable[[dict], float]) -> list[Leaf]:
    """The leaves of one tree from its table of nodes."""
    out = []
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            order = sorted(path)
            cells = [path[f] for f in order]
            out.append(Leaf(scale * pick(node), tuple(order), tuple(c[0] for c in cells), tuple(c[1] for c in cells), tuple(c[2] for c in cells), tuple(c[3] for c in cells)))
            continue
        split, f = node["split"], node["split"]["featureIndex"]
        low, high, allowed, share = path.get(f, (-np.inf, np.inf, None, 1.0))
        numbers = split["leftCategoriesOrThreshold"]
        whole = max(sum(node["impurityStats"]), 1e-300) if node["rawCount"] <= 0 else node["rawCount"]
        for side, child in (("left", node["leftChild"]), ("right", node["rightChild"])):
            below = nodes[child]
            part = (sum(below["impurityStats"]) if below["rawCount"] <= 0 else below["rawCount"]) / whole
            if split["numCategories"] < 0:
                cell = (low, min(high, numbers[0]), allowed, share * part) if side == "left" else (max(low, numbers[0]), high, allowed, share * part)
            else:
                kept = set(map(float, numbers)) if side == "left" else set(map(float, range(split["numCategories"]))) - set(map(float, numbers))
                cell = (low, high, tuple(sorted(kept if allowed is None else kept & set(allowed))), share * part)
            todo.append((child, {**path, f: cell}))
    return out


def tree_leaves(model, of_class: int | None = None) -> list[Leaf]:
    """The leaves of a fitted tree, forest or boosted model of ``pyspark.ml``.

    Their sum over all trees is the prediction; with ``of_class`` the probability of that class for trees and
    forests.  Boosted classifiers give their margin, as for every label above 0.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "nodeData" in table.columns:
        table = table.select("treeID", "nodeData.*")
        scales = [float(w) for w in model.treeWeights]
        if not type(model).__name__.startswith("GBT"):
            scales = [w / sum(scales) for w in scales]
    else:
        table, scales = table.withColumn("treeID", F.lit(0)), [1.0]
    trees: dict[int, dict] = {}
    for row in table.collect():  # a model, not data: the driver built it
        trees.setdefault(row["treeID"], {})[row["id"]] = row.asDict(recursive=True)

    def pick(node: dict) -> float:
        if of_class is None or type(model).__name__.startswith("GBT"):
            return float(node["prediction"])
        return float(node["impurityStats"][of_class]) / max(sum(node["impurityStats"]), 1e-300)

    return [leaf for t, nodes in sorted(trees.items()) for leaf in _leaves(nodes, scales[t], pick)]


def _product_values(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Shapley values of products over features of ``own`` (in the coalition) or ``other``: rows x features.

    ``own`` and ``other`` have equal shapes.  The weight of a feature is the sum over coalition sizes of the
    coefficients of the polynomial of all other features.
    """
    n, m = own.shape
    table = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    out = np.empty((n, m))
    for j in range(m):
        poly = np.zeros((n, m))
        poly[:, 0] = 1.0
        for i in range(m):
            if i != j:
                poly = poly * other[:, i, None] + np.concatenate([np.zeros((n, 1)), poly[:, :-1]], axis=1) * own[:, i, None]
        out[:, j] = (own[:, j] - other[:, j]) * (poly @ table)
    return out


def tree_values(x: np.ndarray, leaves: Sequence[Leaf], background: np.ndarray | None = None) -> np.ndarray:
    """rows x features: attributions of the sum of leaves, against background rows or the training shares."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if not leaf.features or leaf.value == 0.0:
            continue
        own = leaf.passes(x)
        kinds, which = np.unique(own, axis=0, return_inverse=True)
        if background is None:
            others, weight = np.array([leaf.share]), np.ones(1)
        else:
            others, weight = np.unique(leaf.passes(background), axis=0, return_counts=True)
            weight = weight / len(background)
        a, b = np.repeat(np.arange(len(kinds)), len(others)), np.tile(np.arange(len(others)), len(kinds))
        values = _product_values(kinds[a].astype(float), others[b].astype(float)) * weight[b, None]
        sums = values.reshape(len(kinds), len(others), -1).sum(axis=1)
        out[:, list(leaf.features)] += leaf.value * sums[which.ravel()]
    return out


def leaf_score(leaves: Sequence[Leaf]) -> MatrixScore:
    """The sum of the leaves that each row reaches, as a matrix score."""

    def score(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for leaf in leaves:
            out += leaf.value * leaf.passes(x).all(axis=1)
        return out

    return score


def tree_shapley(rows: DataFrame, key: str, features: Sequence[str], leaves: Sequence[Leaf], background: Sequence[dict] | None = None) -> DataFrame:
    """``id, feature, value, shap`` of a tree model by its paths; exact for any number of features.

    With a background the features outside a coalition come from its rows; without one they pass a split as often
    as the training rows did.
    """
    back = None if background is None else np.array([[float(b[f]) for f in features] for b in background])
    return _per_row(rows, key, features, lambda x: tree_values(x, leaves, back))
