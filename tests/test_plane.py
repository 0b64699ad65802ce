"""Searches and sums in the plane against all pairs."""

import numpy as np
import pytest

from plumbrule.operators import lloyd, neighbours, plane


def gaps(q, p):
    return np.abs(q[:, None, :] - p[None, :, :]).max(2)


def frame(spark, v, g):
    return spark.createDataFrame([(3 * i, int(h), list(map(float, x))) for i, (h, x) in enumerate(zip(g, v))], "id long, g int, v array<double>")


def crowd(rng):
    """A cloud, lines, a grid with ties and two far rows; every row is there once."""
    v = np.concatenate([rng.normal(size=(500, 2)), np.c_[rng.integers(0, 6, 400), rng.normal(size=400)], rng.integers(0, 20, (300, 2)), [[50.0, 50], [0, -80]]])
    return np.unique(v, axis=0)


@pytest.mark.parametrize("width", [1, 2])
def test_near_rows_of_a_block(width):
    rng = np.random.default_rng(width)
    for p, q in ((rng.normal(size=(900, width)), None), (rng.integers(0, 12, (900, width)).astype(float), None), (rng.normal(size=(3, width)), rng.normal(size=(40, width)))):
        q, ids = p if q is None else q, rng.permutation(len(p)) + 5
        for limit in (np.full(len(q), np.inf), rng.uniform(0, 0.3, len(q))):
            count, name, distance = plane.near_in_block(q, limit, p, ids, 4)
            d, at = gaps(q, p), 0
            for i in range(len(q)):
                best = [j for j in np.lexsort((ids, d[i]))[:4] if d[i, j] <= limit[i]]
                own = slice(at, at := at + count[i])
                assert name[own].tolist() == ids[best].tolist() and distance[own].tolist() == d[i, best].tolist()


def test_a_row_is_measured_against_few_others(monkeypatch):
    """Four times the rows are four times the distances, not sixteen times."""
    rng, cells, measure = np.random.default_rng(1), [], plane._largest_gap
    monkeypatch.setattr(plane, "_largest_gap", lambda q, p: cells.append(len(q) * len(p)) or measure(q, p))
    each = []
    for n in (2_000, 8_000):
        p = rng.uniform(size=(n, 2))
        cells.clear()
        plane.near_in_block(p, np.full(n, np.inf), p, np.arange(n), 4)
        each.append(sum(cells) / n)
    assert each[1] < 1.5 * each[0] < 3_000


def test_search_by_blocks_of_groups(spark, monkeypatch):
    """Small blocks: ties, groups without points and of fewer rows than neighbours, queries beside the points."""
    rng = np.random.default_rng(3)
    v = crowd(rng)
    g = rng.integers(0, 3, len(v))
    g[:2] = 7
    far, mine = rng.normal(size=(200, 2)) * 3, rng.integers(0, 9, 200)
    df, met = frame(spark, v, g), []
    near = plane._packed
    monkeypatch.setattr(plane, "_packed", lambda rows, parts=None: met.append(rows.count()) or near(rows, parts))
    for queries, q, group in ((df, v, g), (frame(spark, far, mine), far, mine)):
        got = {r["id"]: [(b["neighbour"], b["distance"]) for b in r["best"]] for r in plane.search(queries, df, 4, 100).collect()}
        d = gaps(q, v)
        d[group[:, None] != g[None, :]] = np.inf
        for i, row in enumerate(d):
            assert got.get(3 * i, []) == [(3 * int(j), row[j]) for j in np.argsort(row, kind="stable")[:4] if np.isfinite(row[j])]
    assert met[:2] == [len(v), len(v)] and met[2] < 2 * len(v)


def test_many_rows_in_the_plane_need_no_pivots(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = crowd(rng)
    df = frame(spark, v, np.zeros(len(v)))
    want = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in neighbours.nearest(df, df, 3, True, metric=neighbours.chebyshev).collect()}
    monkeypatch.setattr(neighbours, "PLANE_ROWS", 300)
    monkeypatch.setattr(neighbours, "place", None)
    monkeypatch.setattr(plane, "BLOCK_ROWS", 200)
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in neighbours.nearest(df, df, 3, True, metric=neighbours.chebyshev).collect()}
    assert got == want and len(got) == 3 * len(v)


@pytest.mark.parametrize("width", [1, 2])
def test_sums_of_distances_to_every_cluster(width):
    rng = np.random.default_rng(width)
    for x in (rng.uniform(size=(3000, width)), rng.standard_cauchy((3000, width)), np.c_[rng.integers(0, 25, 3000) / 7.0, rng.uniform(-2, 2, 3000)][:, -width:], np.zeros((700, width))):
        weights = np.zeros((len(x), 5))
        weights[np.arange(len(x)), rng.integers(0, 5, len(x))] = rng.integers(1, 4, len(x))
        tree = plane.Tree(x, 100)
        got = plane.distance_sums(tree, [(tree, weights[tree.order])])
        want = np.sqrt(((tree.x[:, None] - tree.x[None]) ** 2).sum(2)) @ weights[tree.order]
        assert np.allclose(got, want, rtol=1e-10, atol=0)


def test_boxes_apart_meet_by_their_moments(monkeypatch):
    """Four times the rows are not sixteen times the distances."""
    rng, cells, measure = np.random.default_rng(2), [], plane._distances
    monkeypatch.setattr(plane, "_distances", lambda q, p: cells.append(len(q) * len(p)) or measure(q, p))
    whole = []
    for n in (10_000, 40_000):
        tree = plane.Tree(rng.uniform(size=(n, 2)))
        cells.clear()
        plane.distance_sums(tree, [(tree, np.ones((n, 1)))])
        whole.append(sum(cells))
    assert whole[1] < 7 * whole[0] and whole[1] < 0.6 * 40_000**2


def test_silhouettes_of_many_rows_in_the_plane_build_no_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.concatenate([crowd(rng), rng.normal(size=(2500, 2)) + 4])
    v = np.concatenate([v, v[:300]])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    far = v[np.abs(v).sum(axis=1).argmax()]
    models = [v[[0, 900]], np.array([v[0], v[400], far])]
    labelled = lloyd.many_labelled(df, models)
    want = neighbours.mean_silhouettes(labelled, [2, 3])
    monkeypatch.setattr(neighbours, "PLANE_ROWS", 300)
    monkeypatch.setattr(neighbours, "_tile_sums", None)
    monkeypatch.setattr(plane, "BLOCK_ROWS", 300)
    monkeypatch.setattr(plane, "SUM_LEAF", 64)
    assert np.allclose(neighbours.mean_silhouettes(labelled, [2, 3]), want, rtol=1e-9, atol=0)
