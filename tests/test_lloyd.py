"""Many K-means models in one pass against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrule.operators import clusters, lloyd


def points(spark, x):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9], [9, 9, 9]])
    return np.concatenate([rng.normal(c, 0.6, (60, 3)) for c in centres])


def test_one_round_of_many_models(spark, groups):
    models = [groups[:2], groups[::50], np.array([[100.0] * 3, [0.0] * 3])]
    new, sizes, inertia = lloyd.lloyd_round(points(spark, groups).repartition(3), models)
    for got, size, cost, old in zip(new, sizes, inertia, models):
        gaps = ((groups[:, None, :] - old[None]) ** 2).sum(2)
        own = gaps.argmin(1)
        assert size.tolist() == np.bincount(own, minlength=len(old)).tolist()
        assert cost == pytest.approx(gaps.min(1).sum())
        assert np.allclose(got, [groups[own == c].mean(0) if (own == c).any() else old[c] for c in range(len(old))])


def test_ten_starts_of_all_k_find_the_groups(spark, groups):
    df = points(spark, groups)
    found = lloyd.many_kmeans(df, range(2, 8), 10, seed=3)
    assert sorted(found) == list(range(2, 8)) and all(len(runs) == 10 for runs in found.values())
    best = {k: runs[0][0] for k, runs in found.items()}
    own = sum(((groups[i : i + 60] - groups[i : i + 60].mean(0)) ** 2).sum() for i in range(0, 300, 60))
    assert best[5] == pytest.approx(own)
    assert all(best[k] > best[k + 1] for k in range(2, 7))
    for k, runs in found.items():
        for cost, centres in runs[:2]:
            gaps = ((groups[:, None, :] - centres[None]) ** 2).sum(2)
            assert gaps.min(1).sum() == pytest.approx(cost, rel=1e-4)
            # a fixed point: every centre is the mean of its rows
            assert np.allclose(centres, [groups[gaps.argmin(1) == c].mean(0) for c in range(len(centres))], atol=1e-3)
    again = lloyd.many_kmeans(df.repartition(5), [5], 10, seed=3)[5]
    assert len(again) == 10 and again[0][0] == pytest.approx(own)


def test_rows_that_coincide_give_fewer_centres(spark):
    df = points(spark, np.repeat([[0.0, 1.0], [5.0, 5.0]], 10, axis=0))
    found = lloyd.many_kmeans(df, [2, 4], 3)
    assert [len(c) for _, c in found[4]] == [2, 2, 2] and found[4][0][0] == pytest.approx(0.0)


def test_report_has_labels_and_responsibilities(spark, groups):
    rows = [(i, *map(float, r)) for i, r in enumerate(groups)] + [(999, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    sweep, labels = clusters.cluster_report(df, ["a", "b", "c"], "id", 7, 4)
    table = sweep.collect()
    assert [r["k"] for r in table if r["best"]] == [5] and table[0]["k"] == 5 and len(table) == 6
    got = {r["id"]: r for r in labels.collect()}
    assert len(got) == 301 and got[999]["kmeans"] is None and got[999]["responsibilities"] is None
    assert all(len({got[i]["kmeans"] for i in range(g, g + 60)}) == 1 for g in range(0, 300, 60))
    assert len({got[i]["kmeans"] for i in range(0, 300, 60)}) == 5
    assert all(sum(got[i]["responsibilities"]) == pytest.approx(1.0) and len(got[i]["responsibilities"]) == 5 for i in range(300))
    with pytest.raises(ValueError):
        clusters.cluster_report(df.limit(3), ["a", "b", "c"], "id")


def test_few_rows(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(5)], "id long, a double")
    sweep = clusters.cluster_analysis(df, ["a"], "id", 10, 2)
    assert sorted(r["k"] for r in sweep.collect()) == [2, 3, 4]
    assert sweep.where(F.col("best")).count() == 1
