"""K-means with many starts and many numbers of clusters at once.

A round reads the table once: every task adds up, for every model, the rows and sums of its clusters, and Spark
adds the sums of the tasks.  Models that no longer move drop out.  The starts are seeded by k-means|| (Bahmani
and others, 2012): rows are drawn by a hash with a chance in proportion to their squared distance from what is
drawn so far, all starts in the same passes; weighted k-means++ on the few drawn rows gives an order of centres,
whose first k start the model of k clusters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes of k-means||, and rows that a start draws in each, as a multiple of the largest k.
DRAWS = 3
OVERSAMPLE = 2


def squared_gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gaps = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(gaps, 0.0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _added(points: DataFrame, size: int, partial) -> np.ndarray:
    """Sums of ``size`` cells; ``partial`` adds the vectors of a batch to an array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                partial(out, _vectors(batch))
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(used.astype(np.int64)), "s": pa.array(out[used])})

    out = np.zeros(size)
    for row in points.mapInArrow(work, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        out[row["cell"]] = row["s"]
    return out


def lloyd_round(points: DataFrame, models: Sequence[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """One step of all models over ``id, v``: (new centres, rows per cluster, inertia before the step).

    Rows go to the first of the nearest centres; a cluster without rows keeps its centre.
    """
    width = models[0].shape[1]
    starts = np.cumsum([0, *[len(m) * (width + 1) for m in models]])

    def partial(out: np.ndarray, x: np.ndarray) -> None:
        for i, centres in enumerate(models):
            gaps = squared_gaps(x, centres)
            own = gaps.argmin(axis=1)
            hot = np.zeros((len(centres), len(x)))
            hot[own, np.arange(len(x))] = 1.0
            out[starts[i] : starts[i + 1]] += np.column_stack([hot.sum(axis=1), hot @ x]).ravel()
            out[starts[-1] + i] += gaps[np.arange(len(x)), own].sum()

    cells = _added(points, int(starts[-1]) + len(models), partial)
    new, sizes = [], []
    for i, centres in enumerate(models):
        part = cells[starts[i] : starts[i + 1]].reshape(len(centres), width + 1)
        sizes.append(part[:, 0])
        new.append(np.where(part[:, :1] > 0, part[:, 1:] / np.maximum(part[:, :1], 1), centres))
    return new, sizes, cells[starts[-1] :]


def seeds(points: DataFrame, k: int, starts: int, seed: int = 42) -> list[np.ndarray]:
    """For every start up to ``k`` centres in the order in which k-means++ takes them."""
    first = [np.array(r["v"]) for s in range(starts) for r in points.orderBy(F.xxhash64(F.lit(seed + s), "id"), "id").limit(1).select("v").collect()]
    drawn = [c[None, :] for c in first]
    wanted = OVERSAMPLE * k
    for turn in range(DRAWS):

        def cost(out: np.ndarray, x: np.ndarray, drawn=drawn) -> None:
            for s in range(starts):
                out[s] += squared_gaps(x, drawn[s]).min(axis=1).sum()

        whole = _added(points, starts, cost)

        def draw(batches: Iterator[pd.DataFrame], drawn=drawn, whole=whole) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty:
                    continue
                x = _matrix(batch["v"])
                for s in range(starts):
                    chance = wanted * squared_gaps(x, drawn[s]).min(axis=1) / max(whole[s], 1e-300)
                    hit = np.array([u[s] for u in batch["u"]]) < chance
                    if hit.any():
                        yield pd.DataFrame({"s": s, "v": batch["v"][hit]})

        share = [(F.xxhash64(F.lit(seed + 1000 * (turn + 1) + s), "id").cast("double") / 2.0**64 + 0.5) for s in range(starts)]
        # about ``wanted`` rows a start
        found = points.select("v", F.array(*share).alias("u")).mapInPandas(draw, "s int, v array<double>").orderBy("s", "v").collect()
        for s in range(starts):
            more = [r["v"] for r in found if r["s"] == s]
            if more:
                drawn[s] = np.unique(np.vstack([drawn[s], np.array(more)]), axis=0)
    _, weights, _ = lloyd_round(points, drawn)
    return [_plus_plus(c, w, k, np.random.default_rng(seed + s)) for s, (c, w) in enumerate(zip(drawn, weights))]


def _plus_plus(rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.choice(len(rows), p=weights / weights.sum()))]
    near = squared_gaps(rows, rows[chosen]).ravel()
    while len(chosen) < k:
        chance = near * weights
        if chance.sum() <= 1e-12 * max(weights.sum(), 1.0):
            break
        chosen.append(int(rng.choice(len(rows), p=chance / chance.sum())))
        near = np.minimum(near, squared_gaps(rows, rows[chosen[-1:]]).ravel())
    return rows[chosen]


def many_kmeans(points: DataFrame, ks: Sequence[int], starts: int = 10, seed: int = 42, rounds: int = 100, tolerance: float = 1e-8) -> dict[int, list[tuple[float, np.ndarray]]]:
    """Per number of clusters all starts as (inertia, centres), the best first; fewer centres where rows coincide.

    ``points`` are ``id`` and ``v`` without missing values; they are read once a round whatever the number of models.
    """
    orders = seeds(points, max(ks), starts, seed)
    names = [(k, s) for k in ks for s in range(starts)]
    centres = {n: orders[n[1]][: n[0]] for n in names}
    inertia: dict[tuple[int, int], float] = {}
    moving = list(names)
    for _ in range(rounds):
        new, _, cost = lloyd_round(points, [centres[n] for n in moving])
        still = []
        for n, c, j in zip(moving, new, cost):
            inertia[n] = float(j)
            if ((c - centres[n]) ** 2).sum() > tolerance * max((c * c).sum(), 1e-300):
                centres[n] = c
                still.append(n)
        moving = still
        if not moving:
            break
    if moving:  # the round limit came first: the last centres have not been measured
        _, _, cost = lloyd_round(points, [centres[n] for n in moving])
        inertia |= {n: float(j) for n, j in zip(moving, cost)}
    return {k: sorted(((inertia[k, s], centres[k, s]) for s in range(starts)), key=lambda r: r[0]) for k in ks}


def labelled(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, v, label`` with the number of the nearest centre."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(label=squared_gaps(_matrix(batch["v"]), centres).argmin(axis=1))

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "v").mapInPandas(work, f"id {kind}, v array<double>, label int")


def many_labelled(points: DataFrame, models: Sequence[np.ndarray]) -> DataFrame:
    """``id, v, labels`` with the number of the nearest centre of every model."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["v"])
                yield batch.assign(labels=np.stack([squared_gaps(x, m).argmin(axis=1) for m in models], axis=1).tolist())

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "v").mapInPandas(work, f"id {kind}, v array<double>, labels array<int>")
