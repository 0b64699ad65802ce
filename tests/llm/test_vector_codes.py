"""Exact integer quantisation against plain Python integers."""

import hashlib
import random

import numpy as np
import pytest

from plumbrule.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, id string"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label) without faults, in order of vec_id."""
    whole = [[int(np.floor(np.float64(x) * 4096)) for x in v] for _, v, _ in rows]
    size = len(whole[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in whole]
    books = [[cut[e][p] for e in range(min(entries, len(rows)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], book)), e) for e, book in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, b in zip(cut, best) if b[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    best = assign()
    errors = [sum(gap for gap, _ in b) for b in best]
    sums = {}
    for (_, _, label), error in zip(rows, errors):
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(k, "".join(f"{e:02x}" for _, e in b), error, sums[label], digest) for (k, _, label), b, error in zip(rows, best, errors)]


def table(spark, rows):
    return spark.createDataFrame([(k, v, label, "x", "y") for k, v, label in rows], SCHEMA)


def result(spark, rows, **options):
    return sorted(map(tuple, vector_codes.code_digest(table(spark, rows), **options).collect()), key=lambda r: (r[0] is None, r[0]))


def vectors(n, width=16, spread=3.0, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([None, 1, 2, 2, 2])) for i in range(n)]


@pytest.mark.parametrize("bits", [3, 12, 13, 25, 27])
def test_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    a, b = (rng.integers(-(1 << bits), 1 << bits, (7, 9)) for _ in range(2))
    a[0], b[0] = 1 << bits, -(1 << bits)
    assert vector_codes.exact_products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert all(np.abs(x).max() <= 1 << vector_codes.LIMB_BITS for x in vector_codes.limbs(a))


@pytest.mark.parametrize("spread", [0.001, 3.0, 5000.0])
def test_equals_plain_integers(spark, spread):
    rows = vectors(300, spread=spread)
    assert result(spark, rows) == brute(rows)


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, [float(i % 3)] * 8, 1) for i in range(60)]
    got = result(spark, rows)
    assert got == brute(rows)
    assert {r[1] for r in got} == {"00" * 8, "01" * 8, "02" * 8}


def test_left_out_rows_and_rows_without_a_code(spark):
    good = vectors(40)
    bad = [(100, None, 1), (101, [1.0] * 15 + [None], 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] + [0.0] * 15, 1)]
    odd = [(200, [1.0] * 7, 1), (201, [], None), (202, [1e12] * 16, 1), (203, [300_000.0] * 16, 1), (204, [1e300] * 16, 2)]
    got = result(spark, good + bad + odd)
    expected = brute(good)
    sums = {label: e[3] for (_, _, label), e in zip(good, expected)}
    assert vector_codes.largest_component(16) < 300_000 * 4096
    assert got == expected + [(k, None, None, sums[label], expected[0][4]) for k, _, label in odd]


def test_repeated_and_missing_ids(spark):
    rows = vectors(30) + [(None, [9.0] * 16, 1)]
    again = rows + [rows[0], rows[0]]
    got = result(spark, again)
    assert len(got) == 33 and got[0] == got[1] == got[2]
    # the copies of the smallest id stand first in the codebook
    assert got == sorted(brute([(r[0], r[1], r[2]) for r in [rows[0], rows[0], *rows]]), key=lambda r: (r[0] is None, r[0]))


def test_few_vectors_and_uneven_parts(spark):
    rows = [(3, [1.0, 2.0, 3.0], None), (5, [0.5, 2.0, 3.0], None)]
    got = result(spark, rows)
    assert [r[1:4] for r in got] == [("00" * 8, 0, 0), ("01" + "00" * 7, 0, 0)]
    assert result(spark, [(1, [], 4)]) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, None, 1)]) == []


def test_many_labels(spark):
    rows = [(i, [float(i % 7), 1.0] * 4, None if i % 3 == 0 else 0 if i % 3 == 1 else i) for i in range(5000)]
    got = result(spark, rows, rounds=1)
    sums = {}
    for (_, _, label), r in zip(rows, got):
        sums[label] = sums.get(label, 0) + r[2]
    assert [r[3] for r in got] == [sums[label] for _, _, label in rows]
