"""Depths of the forest chosen text by text."""

import pytest

from plumbrule.llm import forest_join, minhash
from tests.llm.common import documents, prose, shingles
from tests.llm.test_brute_force import linked


def test_estimate_of_one_text():
    levels = [0] * minhash.SIMILARITY_BINS
    alone = forest_join.estimated_recall(levels, 8, 16, 0.8)
    assert alone == pytest.approx(minhash.recall_at(0.8, 8, 16))
    close = forest_join.estimated_recall([*levels[:-1], 50], 8, 16, 0.8)
    loose = forest_join.estimated_recall([50, *levels[1:]], 8, 16, 0.8)
    assert loose == pytest.approx((50 + alone) / (50 / alone + 1)) and loose < 0.96 < 0.995 < close
    # at the least depth nobody goes on, whatever has been found
    floor = forest_join.least_depth(16, 0.8, 0.995)
    assert all(forest_join.estimated_recall([n, *levels[1:]], floor, 16, 0.8) >= 0.995 for n in (0, 1, 10**9))


@pytest.mark.parametrize("nodes", [512, 8])
def test_stopped_texts_are_met_by_open_ones(spark, monkeypatch, nodes):
    """A crowd that stops at whole labels, and texts at the threshold of its members, in buckets of one and of many blocks."""
    monkeypatch.setattr(forest_join, "BLOCK_NODES", nodes)
    base = prose(1, 400, 3000).split()
    rows = [(i, " ".join([*base[: 2 * i], f"new{i}", *base[2 * i + 1 :]])) for i in range(200)]
    for i in range(3):  # eight changed words: about 0.82 with a member of the crowd
        changed = {(7 * i + 50 * k) % 400: f"far{i}" for k in range(8)}
        rows.append((1000 + i, " ".join(changed.get(k, w) for k, w in enumerate(base))))
    stopped = []
    first = forest_join.unfinished
    monkeypatch.setattr(forest_join, "unfinished", lambda *a: (lambda out: (stopped.append(out), out)[1])(first(*a)))
    found = {r["doc_id"]: r for r in forest_join.join_texts(documents(spark, rows)).collect()}
    links = linked({k: shingles(t) for k, t in rows})
    got, want = sum(r["n_links"] for r in found.values()), sum(map(len, links.values()))
    assert 0.985 * want <= got <= want and all(found[k]["n_links"] <= len(links[k]) for k in found)
    assert all(found[k]["class_id"] == 0 for k in found if links[k])
    assert 0 < stopped[0].where("open").count() <= 20  # nearly all of the crowd stop at once


def test_buckets_compared_before_are_left_out(spark):
    """Halves of keys share a number; an odd number of trees, and keys below zero."""
    key = lambda x: x << 32 | 77
    keys = {"a": (1, 2, 9), "b": (1, 3, 9), "c": (4, 5, 8), "d": (-6, 7, 8), "e": (10, -11, 12), "f": (-13, -11, 14), "g": (20, 21, -22), "h": (23, 21, -22)}
    nodes = spark.createDataFrame([(bytearray(n.encode()), 3, [key(x) for x in k]) for n, k in keys.items()], "node binary, n_shingles long, k array<long>")
    found = minhash.crowded(nodes, "k", [("k", True)])
    assert {(r["tree"], r["key"] >> 32, r["members"], r["weight"]) for r in found.collect()} == {(0, 1, 2, 6), (1, -11, 2, 6), (1, 21, 2, 6), (2, 8, 2, 6)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("bit_or(") == 2  # a number for two trees
