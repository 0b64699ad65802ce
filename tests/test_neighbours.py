"""Neighbour search by pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrule.operators import neighbours

SCHEMA = "id long, v array<double>, label int, g int"


def frame(spark, v, label=None, g=None):
    n = len(v)
    label = np.zeros(n, int) if label is None else label
    g = np.zeros(n, int) if g is None else g
    return spark.createDataFrame([(i, None if p is None else list(map(float, p)), int(k), int(h)) for i, (p, k, h) in enumerate(zip(v, label, g))], SCHEMA)


def distances(a, b, metric="euclidean"):
    gap = np.abs(a[:, None, :] - b[None, :, :])
    return gap.max(2) if metric == "chebyshev" else np.sqrt((gap * gap).sum(2))


def ranked(d, k):
    """The k nearest columns of every row; the smaller number first on ties."""
    return [[(int(j), float(row[j])) for j in np.argsort(row, kind="stable")[:k] if np.isfinite(row[j])] for row in d]


def found(df, n):
    out = [[] for _ in range(n)]
    for r in df.orderBy("id", "rank").collect():
        assert r["rank"] == len(out[r["id"]]) + 1
        out[r["id"]].append((r["neighbour"], r["distance"]))
    return out


def same(got, want):
    assert [[j for j, _ in row] for row in got] == [[j for j, _ in row] for row in want]
    assert np.allclose([d for row in got for _, d in row], [d for row in want for _, d in row])


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.uniform(-60, 60, (40, 6))
    return np.concatenate([rng.normal(c, 0.5, (100, 6)) for c in centres]), np.repeat(np.arange(40), 100)


def test_clustered_rows_visit_few_blocks(spark, clustered):
    v, _ = clustered
    df, report = frame(spark, v), {}
    d = distances(v, v)
    np.fill_diagonal(d, np.inf)
    same(found(neighbours.nearest(df, df, 5, True, 50, report=report), len(v)), ranked(d, 5))
    assert report["pairs"] < 0.08 * len(v) ** 2


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
@pytest.mark.parametrize("block", [7, 4096])
def test_other_points_and_far_queries(spark, metric, block):
    rng = np.random.default_rng(5)
    p, q = rng.uniform(0, 1, (300, 3)), np.concatenate([rng.uniform(0, 1, (40, 3)), [[50.0, 50, 50], [-9, 0, 0]]])
    got = neighbours.nearest(frame(spark, q), frame(spark, p), 3, block_rows=block, metric=getattr(neighbours, metric))
    same(found(got, len(q)), ranked(distances(q, p, metric), 3))


@pytest.mark.parametrize("block", [16, 4096])
def test_ties_and_a_third_of_the_rows_in_one_place(spark, block):
    rng = np.random.default_rng(6)
    v = np.concatenate([np.zeros((200, 2)), rng.integers(0, 6, (400, 2))]).astype(float)
    d = distances(v, v)
    np.fill_diagonal(d, np.inf)
    report = {}
    same(found(neighbours.nearest(frame(spark, v), frame(spark, v), 4, True, block, report=report), len(v)), ranked(d, 4))
    assert report["pairs"] <= 36 * 36


def test_groups_meet_only_themselves(spark):
    rng = np.random.default_rng(7)
    v, g = rng.normal(0, 1, (240, 2)), np.repeat([0, 1, 2], [200, 37, 3])
    d = distances(v, v)
    d[g[:, None] != g[None, :]] = np.inf
    np.fill_diagonal(d, np.inf)
    df = frame(spark, v, g=g)
    same(found(neighbours.nearest(df, df, 5, True, 20), len(v)), ranked(d, 5))


def test_few_points_missing_vectors_and_empty_tables(spark):
    df = frame(spark, [[0.0], None, [2.0], [2.0]])
    got = found(neighbours.nearest(df, df, 5, True), 4)
    assert got == [[(2, 2.0), (3, 2.0)], [], [(3, 0.0), (0, 2.0)], [(2, 0.0), (0, 2.0)]]
    for q, p in [(df, df.limit(0)), (df.limit(0), df), (df.limit(0), df.limit(0))]:
        assert neighbours.nearest(q, p, 2).collect() == []
        assert neighbours.kernel_vote(q, p).collect() == []
    assert neighbours.silhouette(df.limit(0)).collect() == []


def test_votes_and_means_of_neighbours(spark, clustered):
    v, label = clustered
    y = np.arange(len(v)) * 0.5
    df = frame(spark, v, label % 5)
    near = [[j for j, _ in row] for row in ranked(distances(v, v) + np.diag([np.inf] * len(v)), 3)]
    got = {r["id"]: r["prediction"] for r in neighbours.knn_vote(df, df, 3, True).collect()}
    votes = [np.bincount([label[j] % 5 for j in row]).argmax() for row in near]
    assert [got[i] for i in range(len(v))] == votes
    means = {r["id"]: r["prediction"] for r in neighbours.knn_mean(df, df.withColumn("y", F.col("id") * 0.5), 3, True).collect()}
    assert np.allclose([means[i] for i in range(len(v))], [np.mean(y[row]) for row in near])


def test_kernel_vote_leaves_out_only_what_no_bit_shows(spark, clustered):
    v, label = clustered
    v = np.concatenate([v, v[:200]])  # copies
    label = np.concatenate([label, (label[:200] + 1) % 3]) % 3
    df, report = frame(spark, v, label), {}
    w = np.exp(-distances(v, v) / 0.2)
    np.fill_diagonal(w, 0)
    sums = np.stack([w[:, label == k].sum(1) for k in range(3)], axis=1)
    want = sums / (sums.sum(1, keepdims=True) + 1e-12)
    got = neighbours.kernel_vote(df, df, 0.2, True, 50, report).collect()
    assert len(got) == 3 * len(v)
    assert np.allclose([r["p"] for r in sorted(got, key=lambda r: (r["id"], r["label"]))], want.ravel(), rtol=1e-9, atol=1e-13)
    assert report["pairs"] < 0.3 * len(v) ** 2


def test_silhouette_visits_near_clusters_only(spark, clustered):
    v, label = clustered
    v, label = np.concatenate([v, v[:150], [[500.0] * 6]]), np.concatenate([label, label[:150], [99]])
    report = {}
    got = {r["id"]: r for r in neighbours.silhouette(frame(spark, v, label), 64, report).collect()}
    d, want = distances(v, v), []
    for i, own in enumerate(label):
        mine = (label == own).sum() - 1
        a = d[i, label == own].sum() / max(mine, 1)
        b = min(d[i, label == k].mean() for k in set(label.tolist()) - {own})
        want.append((b - a) / max(a, b) if mine else 0.0)
    assert np.allclose([got[i]["silhouette"] for i in range(len(v))], want)
    assert [got[i]["label"] for i in range(len(v))] == label.tolist()
    assert report["pairs"] < 0.1 * len(v) ** 2


def test_silhouette_without_a_label_table(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v, label = rng.normal(0, 1, (60, 2)), rng.integers(0, 4, 60)
    want = {r["id"]: r["silhouette"] for r in neighbours.silhouette(frame(spark, v, label)).collect()}
    monkeypatch.setattr(neighbours, "LABEL_NUMBERS", 1)
    got = {r["id"]: r["silhouette"] for r in neighbours.silhouette(frame(spark, v, label)).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in got], [want[i] for i in got])


def test_synthetic_rows_lie_between_minority_neighbours(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), "few" if i < 30 else "many") for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y string")
    made = neighbours.smote(df, ["a", "b"], "y", "few", per_row=2, k=3).collect()
    few = np.array([r[1:3] for r in rows[:30]])
    near = np.argsort(distances(few, few) + np.diag([np.inf] * 30), axis=1)[:, :3]
    assert len(made) == 60 and {r["y"] for r in made} == {"few"}
    for r in made:
        p = np.array([r["a"], r["b"]])
        gaps = [abs(np.linalg.norm(p - few[i]) + np.linalg.norm(p - few[j]) - np.linalg.norm(few[i] - few[j])) for i in range(30) for j in near[i]]
        assert min(gaps) < 1e-9


def test_near_pairs_by_single_precision_lose_none():
    """Far from the origin, in crowds and with equal rows every pair within the limit is listed, and few others."""
    rng = np.random.default_rng(5)
    for scale, shift in ((1.0, 0.0), (1e-6, 0.0), (1.0, 1e6), (1e-25, 0.0), (1e12, 0.0)):
        p = rng.normal(size=(600, 32)) * scale + shift
        p[100:120] = p[7]
        q = np.concatenate([p[:50], rng.normal(size=(50, 32)) * scale + shift])
        exact = neighbours._by_differences(q, p)
        kth = np.sort(exact, axis=1)[:, 4]
        limit = np.where(np.arange(100) % 2 == 0, kth, np.inf)
        row, column = neighbours._may_be_near(q, p, limit, 5)
        listed = np.zeros(exact.shape, bool)
        listed[row, column] = True
        assert listed[exact <= kth[:, None]].all()
        assert scale < 1e-20 or len(row) < 0.1 * exact.size
    assert neighbours._may_be_near(q * 1e10, p * 1e10, limit, 5) is None
