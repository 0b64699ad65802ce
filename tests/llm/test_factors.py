"""Longest previous factors against a plain comparison of all suffixes, and equal hashes of different bytes."""

import numpy as np
import pytest

from plumbrule.llm import suffix_dedup


def _segments(seed: int, letters: int, count: int, length: int):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(97, 97 + letters, int(rng.integers(length, 3 * length))).astype(np.uint8) for _ in range(count)]
    for i in range(1, count, 2):  # repeats inside and across documents
        parts[i] = np.concatenate([parts[i], parts[i - 1][: int(rng.integers(1, len(parts[i - 1])))]])
    doc = rng.integers(0, max(2, count // 2), count)
    offsets = np.cumsum([0, *[len(p) for p in parts]])
    sizes = np.array([len(p) - length + 1 for p in parts])
    starts = np.concatenate([o + np.arange(n) for o, n in zip(offsets, sizes)])
    return np.concatenate(parts), starts, np.repeat(doc, sizes)


def _shared(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters", [1, 2, 4, 20])
@pytest.mark.parametrize("length", [26, 50, 61])
def test_previous_factors(letters, length):
    data, starts, doc = _segments(letters * length, letters, 6, length)
    found = suffix_dedup.previous_factors(data, starts, suffix_dedup.depth_ranks(data, starts, length), doc, length)
    strings = [data[s : s + length].tobytes() for s in starts]
    for i, own in enumerate(strings):
        assert found[i] == max((_shared(own, o) for o, d in zip(strings, doc) if d < doc[i]), default=0)


def test_no_suffixes():
    none = np.zeros(0, np.int64)
    assert len(suffix_dedup.previous_factors(np.zeros(0, np.uint8), none, none.view(np.uint64), none, 50)) == 0


def test_long_descents_of_documents():
    """Pointers over a long run of equal suffixes, of falling and of equal documents."""
    data = np.full(5_000, 97, np.uint8)
    starts = np.arange(len(data) - 49)
    rank = np.zeros(len(starts), np.uint64)
    falling = np.arange(len(starts))[::-1].copy()
    assert (suffix_dedup.previous_factors(data, starts, rank, falling, 50) == np.where(falling > 0, 50, 0)).all()
    assert not suffix_dedup.previous_factors(data, starts, rank, np.zeros(len(starts), np.int64), 50).any()


def test_equal_hashes_of_different_bytes_are_kept_apart():
    sizes = np.ones(3, np.int64)
    data = np.frombuffer(b"a" * 50 + b"b" * 50 + b"a" * 50, np.uint8)
    code, route = np.full(3, 5, np.uint64), np.full(3, 9, np.int64)
    rows = suffix_dedup._merged_segments([(route, np.array([1, 2, 3]), np.zeros(3, np.int64), np.zeros(3, np.int64), sizes, code, data)], 50)
    kept = [r["doc_id"] for r in rows.to_pylist() if r["segment"] is not None]
    assert 1 in kept and 2 in kept
