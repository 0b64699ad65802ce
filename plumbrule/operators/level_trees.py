"""Trees grown level by level, many at once: extremely randomised trees and histogram boosting.

The trees live on the driver as small arrays; rows stay where they are and find their node by descending the
trees so far.  A level costs one or two aggregates: tasks add up statistics per open node in arrays, Spark adds
the arrays of the tasks cell by cell, and the driver, which gets no more cells than ``CELLS`` at a time, picks
the splits.  Random choices are hashes of tree, node and feature, so they depend on neither rows nor partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrule.core.session import cut_lineage

#: Cells of statistics that one aggregate returns; a level with more is done in several.
CELLS = 400_000
Draw = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def hashed_share(seed: int) -> Draw:
    """Uniform numbers in [0, 1) from (tree, node, feature)."""

    def draw(tree: np.ndarray, node: np.ndarray, feature: np.ndarray) -> np.ndarray:
        x = (np.asarray(tree, np.uint64) << np.uint64(40)) ^ (np.asarray(node, np.uint64) << np.uint64(20)) ^ np.asarray(feature, np.uint64)
        x = np.atleast_1d(x + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x >> np.uint64(11)).astype(float) / 2.0**53

    return draw


@dataclass
class Trees:
    """Node ``i`` has children ``2 i + 1`` (at most the threshold) and ``2 i + 2``; leaves have feature -1."""

    feature: np.ndarray  #: trees x nodes
    threshold: np.ndarray
    value: np.ndarray  #: trees x nodes x outputs

    @staticmethod
    def empty(trees: int, depth: int, outputs: int) -> Trees:
        nodes = 2 ** (depth + 1) - 1
        return Trees(np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes, outputs)))

    def node_of(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            feature = self.feature[tree, at]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                return at
            at[inner] = 2 * at[inner] + 1 + (x[inner, feature[inner]] > self.threshold[tree, at[inner]])

    def total(self, x: np.ndarray, trees: range | None = None) -> np.ndarray:
        """rows x outputs: sum of the values that each row reaches."""
        out = np.zeros((len(x), self.value.shape[2]))
        for t in trees if trees is not None else range(len(self.feature)):
            out += self.value[t, self.node_of(x, t)]
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def _summed(data: DataFrame, cells: int, kinds: dict[str, str], partial: Callable[[Iterator[pd.DataFrame]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Statistics per cell: ``partial`` makes one array per kind in every task, Spark combines them ('sum', 'min', 'max')."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(b.to_pandas() for b in batches if b.num_rows)
        used = np.flatnonzero(np.any([np.isfinite(v) & (v != 0) if kinds[k] == "sum" else np.isfinite(v) for k, v in found.items()], axis=0))
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used.astype(np.int64)), **{k: pa.array(v[used]) for k, v in found.items()}})

    sums = data.mapInArrow(work, "cell long, " + ", ".join(f"{k} double" for k in kinds))
    table = sums.groupBy("cell").agg(*[getattr(F, how)(k).alias(k) for k, how in kinds.items()]).toPandas()
    out = {}
    for k, how in kinds.items():
        out[k] = np.full(cells, {"sum": 0.0, "min": np.inf, "max": -np.inf}[how])
        out[k][table["cell"].to_numpy(dtype=np.int64)] = table[k].to_numpy()
    return out


class ExtraTrees:
    """Extremely randomised trees: one random threshold for each of some random features, the best of these splits.

    Thresholds are drawn between the least and the largest value of the feature in the node; features that are
    constant there are passed over.  Every tree sees all rows.  ``task`` is classification (Gini impurity, the
    square root of the features at each node) or regression (squared error, all features).
    """

    def __init__(self, task: str = "classification", trees: int = 100, depth: int = 10, features: int | None = None, least: int = 2, seed: int = 42, features_col: str = "_features", label_col: str = "_label", draw: Draw | None = None):
        if not 0 <= depth <= 16:
            raise ValueError("depth must be from 0 to 16")
        self.task, self.trees, self.depth, self.features, self.least, self.seed = task, trees, depth, features, least, seed
        self.features_col, self.label_col, self.draw = features_col, label_col, draw

    def fit(self, df: DataFrame) -> ExtraTreesModel:
        data = df.select(vector_to_array(self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y"))
        facts = data.agg(F.max(F.size("x")).alias("d"), F.max("y").alias("top"), F.avg("y").alias("mean")).first()
        if facts["d"] is None:
            raise ValueError("no rows to learn from")
        d, classes = facts["d"], int(facts["top"]) + 1 if self.task == "classification" else 0
        shift, stats = float(facts["mean"]), classes or 3
        wanted = self.features or (max(1, int(math.sqrt(d))) if classes else d)
        trees = Trees.empty(self.trees, self.depth, classes or 1)
        self.gains: dict[tuple[int, int], float] = {}
        open_ = [(t, 0) for t in range(self.trees)]
        for level in range(self.depth + 1):
            following = []
            width = max(1, CELLS // max(d, (wanted + 1) * stats))
            for at in range(0, len(open_), width):
                following += self._split(data, trees, open_[at : at + width], d, wanted, classes, shift, level == self.depth)
            open_ = following
            if not open_:
                break
        return ExtraTreesModel(trees, classes, self.features_col)

    def _split(self, data: DataFrame, trees: Trees, open_: list[tuple[int, int]], d: int, wanted: int, classes: int, shift: float, last: bool) -> list[tuple[int, int]]:
        """Split the open nodes and return those of their children that may be split again."""
        tree, node = (np.array(c) for c in zip(*open_))
        number = {(t, i): k for k, (t, i) in enumerate(open_)}
        own_trees = sorted(set(tree.tolist()))
        index = np.full((max(own_trees) + 1, trees.feature.shape[1]), -1)
        index[tree, node] = np.arange(len(open_))
        context = data.sparkSession.sparkContext.broadcast((trees, index))

        def ranges(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
            grown, place = context.value
            low, high = np.full((len(tree), d), np.inf), np.full((len(tree), d), -np.inf)
            for batch in batches:
                x = _matrix(batch["x"])
                for t in own_trees:
                    at = place[t, grown.node_of(x, t)]
                    order = np.argsort(at, kind="stable")
                    order = order[at[order] >= 0]
                    if len(order):
                        some, first = np.unique(at[order], return_index=True)
                        low[some] = np.minimum(low[some], np.minimum.reduceat(x[order], first, axis=0))
                        high[some] = np.maximum(high[some], np.maximum.reduceat(x[order], first, axis=0))
            return {"low": low.ravel(), "high": high.ravel()}

        picked, cuts = np.zeros((len(tree), 0), np.int64), np.zeros((len(tree), 0))
        if not last:
            found = _summed(data, len(tree) * d, {"low": "min", "high": "max"}, ranges)
            low, high = found["low"].reshape(-1, d), found["high"].reshape(-1, d)
            every = np.arange(d)[None, :]
            order = hashed_share(self.seed)(tree[:, None], node[:, None], every)
            order[~(low < high)] = 2.0  # constant features come last and are not used
            picked = np.argsort(order, axis=1, kind="stable")[:, :wanted]
            rows = np.arange(len(tree))[:, None]
            a, b = low[rows, picked], high[rows, picked]
            share = (self.draw or hashed_share(self.seed + 1))(tree[:, None], node[:, None], picked)
            with np.errstate(invalid="ignore"):
                cuts = a + share * (b - a)
                cuts = np.where(cuts >= b, a, cuts)
            cuts[~(a < b)] = np.nan
        slots, stats = picked.shape[1] + 1, classes or 3

        def counts(batches: Iterator[pd.DataFrame]) -> dict[str, np.ndarray]:
            grown, place = context.value
            out = np.zeros((slots, len(tree) * stats))
            for batch in batches:
                x, y = _matrix(batch["x"]), batch["y"].to_numpy()
                for t in own_trees:
                    at = place[t, grown.node_of(x, t)]
                    here = np.flatnonzero(at >= 0)
                    if not len(here):
                        continue
                    at = at[here]
                    if classes:
                        parts = [(at * stats + y[here].astype(np.int64), None)]
                    else:
                        z = y[here] - shift
                        parts = [(at * stats, None), (at * stats + 1, z), (at * stats + 2, z * z)]
                    sides = [np.ones(len(here), bool), *(x[here, picked[at, j]] <= cuts[at, j] for j in range(slots - 1))]
                    for j, side in enumerate(sides):
                        for cell, weight in parts:
                            out[j] += np.bincount(cell[side], None if weight is None else weight[side], out.shape[1])
            return {"n": out.ravel()}

        cells = _summed(data, slots * len(tree) * stats, {"n": "sum"}, counts)["n"].reshape(slots, len(tree), stats)
        context.destroy()
        total, left = cells[0], cells[1:]
        trees.value[tree, node] = self._values(total, shift, classes)
        if last:
            return []
        gain = _loss(total, classes) - _loss(left, classes) - _loss(total[None] - left, classes)
        usable = np.isfinite(cuts.T) & (_size(left, classes) > 0) & (_size(total[None] - left, classes) > 0)
        gain = np.where(usable, gain, -np.inf)
        best = gain.argmax(axis=0) if len(gain) else np.zeros(len(tree), np.int64)
        following = []
        for k, (t, i) in enumerate(open_):
            size, j = float(_size(total[k], classes)), best[k]
            if size < self.least or _loss(total[k], classes) <= 1e-12 * size or not len(gain) or not np.isfinite(gain[j, k]):
                continue
            trees.feature[t, i], trees.threshold[t, i] = picked[k, j], cuts[k, j]
            self.gains[t, i] = float(gain[j, k]) / size
            trees.value[t, 2 * i + 1] = self._values(left[j, k][None], shift, classes)[0]
            trees.value[t, 2 * i + 2] = self._values((total[k] - left[j, k])[None], shift, classes)[0]
            following += [(t, 2 * i + 1), (t, 2 * i + 2)]
        return following

    @staticmethod
    def _values(stats: np.ndarray, shift: float, classes: int) -> np.ndarray:
        n = np.maximum(_size(stats, classes), 1e-300)[:, None]
        return stats / n if classes else stats[:, 1:2] / n + shift


def _size(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(axis=-1) if classes else stats[..., 0]


def _loss(stats: np.ndarray, classes: int) -> np.ndarray:
    """Rows times impurity: Gini of class counts, or squared error from (n, sum, sum of squares)."""
    n = np.maximum(_size(stats, classes), 1e-300)
    if classes:
        return n - (stats * stats).sum(axis=-1) / n
    return np.maximum(stats[..., 2] - stats[..., 1] ** 2 / n, 0.0)


def _with_outputs(df: DataFrame, features_col: str, outputs: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(list(outputs(_matrix(x))), dtype=object) if len(x) else pd.Series([], dtype=object)

    return df.withColumn("_outputs", F.pandas_udf(score, "array<double>")(vector_to_array(features_col)))


def _argmax(column: str):
    return (F.array_position(column, F.array_max(column)) - 1).cast("double")


@dataclass
class ExtraTreesModel:
    trees: Trees
    classes: int
    features_col: str = "_features"

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and ``probability`` for classes: the mean over the trees."""
        trees, n = self.trees, len(self.trees.feature)
        out = _with_outputs(df, self.features_col, lambda x: trees.total(x) / n)
        if self.classes:
            out = out.withColumn("probability", array_to_vector("_outputs"))
        return out.withColumn("prediction", _argmax("_outputs") if self.classes else F.col("_outputs")[0]).drop("_outputs")


class HistogramBoosting:
    """Gradient boosting over one shared table of bins: one tree a class and round, all grown together.

    With three classes or more the gradients are those of the softmax loss, with two of the logistic loss
    (one tree a round), for numbers of the squared error.  A level is one aggregate of gradient, curvature and
    rows per (tree, node, feature, bin).  Rows keep their bins and their margins, which are written anew every
    ``cut`` rounds.
    """

    def __init__(self, task: str = "classification", rounds: int = 100, rate: float = 0.1, depth: int = 5, bins: int = 255, least: int = 20, ridge: float = 0.0, seed: int = 42, features_col: str = "_features", label_col: str = "_label", cut: int = 10):
        if not 2 <= bins <= 255 or not 1 <= depth <= 12:
            raise ValueError("bins must be from 2 to 255, depth from 1 to 12")
        self.task, self.rounds, self.rate, self.depth, self.bins, self.least, self.ridge = task, rounds, rate, depth, bins, least, ridge
        self.features_col, self.label_col, self.cut = features_col, label_col, cut

    def _edges(self, data: DataFrame, d: int) -> list[np.ndarray]:
        steps = [i / self.bins for i in range(1, self.bins)]
        row = data.agg(*[F.percentile_approx(F.col("x")[i], steps, 10_000).alias(f"e{i}") for i in range(d)], *[F.max(F.col("x")[i]).alias(f"m{i}") for i in range(d)]).first()
        # a cut at the largest value would leave the right side empty
        return [np.array(sorted({e for e in row[f"e{i}"] if e < row[f"m{i}"]})) for i in range(d)]

    def fit(self, df: DataFrame) -> HistogramModel:
        data = df.select(vector_to_array(self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y"))
        facts = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max("y").alias("top"), F.avg("y").alias("mean")).first()
        if not facts["n"]:
            raise ValueError("no rows to learn from")
        n, d = facts["n"], facts["d"]
        classes = int(facts["top"]) + 1 if self.task == "classification" else 0
        trees_a_round = classes if classes > 2 else 1
        if classes > 2:
            sizes = {int(r["y"]): r["count"] for r in data.groupBy("y").count().collect()}
            start = np.log(np.maximum([sizes.get(c, 0) for c in range(classes)], 1e-9) / n)
        elif classes:
            p = min(max(facts["mean"], 1e-9), 1 - 1e-9)
            start = np.array([math.log(p / (1 - p))])
        else:
            start = np.array([facts["mean"]])
        edges = self._edges(data, d)

        def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["x"])
                    codes = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                    yield pd.DataFrame({"bins": [c.tobytes() for c in codes], "y": batch["y"].to_numpy(), "f": [start.tolist()] * len(batch)})

        rows = cut_lineage(data.mapInPandas(binned, "bins binary, y double, f array<double>"))
        trees = Trees.empty(0, self.depth, trees_a_round)
        fresh = 0  # trees that the written margins do not hold yet
        self.losses: list[float] = []
        self.gains: list[dict[int, float]] = []
        for number in range(self.rounds):
            grown, loss = self._round(rows, trees, fresh, edges, d, classes, trees_a_round)
            self.losses.append(loss / n)
            if (grown.feature[:, 0] < 0).all():
                break
            trees = Trees(*(np.concatenate(c) for c in ((trees.feature, grown.feature), (trees.threshold, grown.threshold), (trees.value, grown.value))))
            fresh += trees_a_round
            if (number + 1) % self.cut == 0 and number + 1 < self.rounds:
                rows, fresh = cut_lineage(self._moved(rows, trees, fresh)), 0
        return HistogramModel(trees, edges, start, classes, self.features_col)

    @staticmethod
    def _decoded(batch: pd.DataFrame, d: int) -> np.ndarray:
        return np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(len(batch), d)

    def _moved(self, rows: DataFrame, trees: Trees, fresh: int) -> DataFrame:
        last = range(len(trees.feature) - fresh, len(trees.feature))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    f = _matrix(batch["f"]) + trees.total(self._decoded(batch, len(batch["bins"].iloc[0])), last)
                    yield batch.assign(f=list(f))

        return rows.mapInPandas(work, "bins binary, y double, f array<double>")

    def _gradients(self, y: np.ndarray, f: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gradient and curvature: rows x trees, loss of every row)."""
        if classes > 2:
            f = f - f.max(axis=1, keepdims=True)
            p = np.exp(f)
            p /= p.sum(axis=1, keepdims=True)
            own = np.arange(classes)[None, :] == y[:, None]
            return p - own, p * (1 - p), -np.log(np.maximum(p[own], 1e-300))
        if classes:
            p = 1 / (1 + np.exp(-f[:, 0]))
            return (p - y)[:, None], (p * (1 - p))[:, None], np.logaddexp(0, f[:, 0]) - y * f[:, 0]
        return f - y[:, None], np.ones_like(f), 0.5 * (f[:, 0] - y) ** 2

    def _round(self, rows: DataFrame, trees: Trees, fresh: int, edges: list[np.ndarray], d: int, classes: int, k: int) -> tuple[Trees, float]:
        grown = Trees.empty(k, self.depth, k)
        codes = Trees(grown.feature, grown.threshold, grown.value)
        last = range(len(trees.feature) - fresh, len(trees.feature))
        open_, loss, gains = [(c, 0) for c in range(k)], 0.0, {}
        width = max(len(e) + 1 for e in edges)
        for level in range(self.depth):
            following = []
            step = max(1, CELLS // (d * width))
            for at in range(0, len(open_), step):
                part = open_[at : at + step]
                index = np.full((k, grown.feature.shape[1]), -1)
                for i, (c, node) in enumerate(part):
                    index[c, node] = i
                first = level == 0 and at == 0

                def histogram(batches: Iterator[pd.DataFrame], index=index, size=len(part), first=first) -> dict[str, np.ndarray]:
                    cells = size * d * width
                    out = {name: np.zeros(cells + 1) for name in ("g", "h", "n")}
                    for batch in batches:
                        x, y = self._decoded(batch, d), batch["y"].to_numpy()
                        g, h, lost = self._gradients(y, _matrix(batch["f"]) + trees.total(x, last), classes)
                        if first:
                            out["g"][cells] += lost.sum()
                        for c in range(k):
                            own = index[c, codes.node_of(x, c)]
                            here = np.flatnonzero(own >= 0)
                            for j in range(d):
                                cell = (own[here] * d + j) * width + x[here, j]
                                out["g"][:cells] += np.bincount(cell, g[here, c], cells)
                                out["h"][:cells] += np.bincount(cell, h[here, c], cells)
                                out["n"][:cells] += np.bincount(cell, minlength=cells)
                    return out

                found = _summed(rows, len(part) * d * width + 1, {"g": "sum", "h": "sum", "n": "sum"}, histogram)
                if first:
                    loss = float(found["g"][-1])
                g, h, n = (np.cumsum(found[c][:-1].reshape(len(part), d, width), axis=2) for c in ("g", "h", "n"))
                following += self._choose(grown, part, g, h, n, edges, gains)
            open_ = following
            if not open_:
                break
        self.gains.append(gains)
        return grown, loss

    def _choose(self, grown: Trees, part: list, g: np.ndarray, h: np.ndarray, n: np.ndarray, edges: list[np.ndarray], gains: dict) -> list:
        total_g, total_h, total_n = (a[:, :1, -1:] for a in (g, h, n))
        score = lambda a, b: a * a / np.maximum(b + self.ridge, 1e-12)
        gain = score(g, h) + score(total_g - g, total_h - h) - score(total_g, total_h)
        inside = np.arange(g.shape[2])[None, None, :] < np.array([len(e) for e in edges])[None, :, None]
        gain = np.where(inside & (n >= self.least) & (total_n - n >= self.least), gain, -np.inf)
        best = gain.reshape(len(part), -1).argmax(axis=1)
        following = []
        for i, (c, node) in enumerate(part):
            j, cut = divmod(int(best[i]), g.shape[2])
            value = lambda a, b: -self.rate * a / max(b + self.ridge, 1e-12)
            if node == 0:
                grown.value[c, 0, c] = value(total_g[i, 0, 0], total_h[i, 0, 0])
            if not gain[i, j, cut] > 1e-9:
                continue
            grown.feature[c, node], grown.threshold[c, node] = j, cut
            gains[c, node] = float(gain[i, j, cut])
            grown.value[c, 2 * node + 1, c] = value(g[i, j, cut], h[i, j, cut])
            grown.value[c, 2 * node + 2, c] = value(total_g[i, 0, 0] - g[i, j, cut], total_h[i, 0, 0] - h[i, j, cut])
            following += [(c, 2 * node + 1), (c, 2 * node + 2)]
        return following


@dataclass
class HistogramModel:
    """Trees over bin numbers; ``edges`` are the largest values of the bins."""

    trees: Trees
    edges: list[np.ndarray]
    start: np.ndarray
    classes: int
    features_col: str = "_features"

    def margins(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)], axis=1)
        return self.start + self.trees.total(codes)

    def splits(self) -> list[tuple[int, int, int, float]]:
        """(tree, node, feature, largest value that goes left) of all splits."""
        t, node = np.nonzero(self.trees.feature >= 0)
        return [(int(a), int(b), int(f := self.trees.feature[a, b]), float(self.edges[f][int(self.trees.threshold[a, b])])) for a, b in zip(t, node)]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and ``probability`` for classes."""

        def outputs(x: np.ndarray) -> np.ndarray:
            f = self.margins(x)
            if self.classes > 2:
                p = np.exp(f - f.max(axis=1, keepdims=True))
                return p / p.sum(axis=1, keepdims=True)
            if self.classes:
                p = 1 / (1 + np.exp(-f))
                return np.concatenate([1 - p, p], axis=1)
            return f

        out = _with_outputs(df, self.features_col, outputs)
        if self.classes:
            out = out.withColumn("probability", array_to_vector("_outputs"))
        return out.withColumn("prediction", _argmax("_outputs") if self.classes else F.col("_outputs")[0]).drop("_outputs")
