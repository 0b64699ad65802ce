"""Byte kernels over Arrow batches of texts, shared by the operators of this subpackage.

All of them work on the UTF-8 bytes of a batch without touching single rows in Python.  A text is never cut:
a block holds whole texts, as many as fit ``BLOCK`` bytes, and at least one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, 2 * BLOCK), base, np.uint64)
        steps[0] = 1
        known = _POWERS[name] = np.cumprod(steps)
    return known[:n]


def plain_strings(column: pa.Array, lower: bool = False) -> pa.Array:
    """The column as strings without nulls, in lower case if wanted."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.utf8_lower(column) if lower else column


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, offsets of the texts in them)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows with at most ``limit`` bytes of text and ``rows`` rows, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(total, done + limit, "right"))))
            yield batch.slice(begin, end - begin)
            begin = end


def byte_class(letters: str, high: bool) -> np.ndarray:
    """Table of 256 booleans: the given ASCII letters, and all bytes of other code points if ``high``."""
    table = np.zeros(256, bool)
    table[np.frombuffer(letters.encode(), np.uint8)] = True
    table[128:] = high
    return table


#: Words of the near-duplicate operators: letters, digits and everything outside ASCII, in lower case.
TOKEN = byte_class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", True)
TOKEN_SQL = "[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+"


#: Code points of scripts that put no spaces between words (first, last): each is a word of its own.
SPACELESS = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x2E80, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)


def spaceless_breaks(buf: np.ndarray) -> np.ndarray:
    """Sorted places where a code point of a script without spaces begins or ends."""
    lead = np.flatnonzero(buf >= 0xE0)
    if not len(lead):
        return lead
    padded = np.concatenate([buf, np.zeros(4, np.uint8)])
    b0, b1, b2, b3 = (padded[lead + i].astype(np.int64) for i in range(4))
    four = b0 >= 0xF0
    point = np.where(four, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63)
    firsts, lasts = np.array(SPACELESS).T
    near = np.searchsorted(firsts, point, "right") - 1
    own = (near >= 0) & (point <= lasts[near])
    return np.unique(np.concatenate([lead[own], np.minimum(lead[own] + 3 + four[own], len(buf))]))


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; a run also ends at every break."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[breaks] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    return np.flatnonzero(mask & (~before | cut[:-1])), np.flatnonzero(mask & (~after | cut[1:])) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, whatever its place."""
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_letters()[buf] * _powers(_BACK, "back", n), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_BASE, "base", n + 1)[starts] + (ends - starts).astype(np.uint64))


def tokens(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray = TOKEN):
    """(starts, ends, hashes, number of words of each text) of the words in a block.

    Scripts without spaces have one word a code point.
    """
    starts, ends = runs(table[buf], np.concatenate([offsets, spaceless_breaks(buf)]))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, span_hashes(buf, starts, ends), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``size`` words inside a text, their number per text).

    A text with fewer words has one shingle of all its words; a text without words has none.
    """
    firsts = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.repeat(firsts[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    last = np.repeat(firsts[1:], sizes)
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for i in range(size):
        place = at + i
        out = out * _BASE + np.where(place < last, padded[np.minimum(place, len(words))], np.uint64(0))
    return mix(out), sizes


def grouped(reduce, values: np.ndarray, sizes: np.ndarray, empty) -> np.ndarray:
    """Reduce the values of consecutive groups; groups without values get ``empty``."""
    out = np.full(len(sizes), empty, values.dtype)
    full = sizes > 0
    if full.any():
        out[full] = reduce.reduceat(values, np.concatenate([[0], np.cumsum(sizes)[:-1]])[full])
    return out


def digests(words: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for the sequence of words of each text; None without words."""
    firsts = np.cumsum(counts) - counts
    place = np.arange(len(words)) - np.repeat(firsts, counts)
    n = int(counts.max(initial=0)) + 1
    one = grouped(np.add, words * _powers(_BASE, "base", n)[place], counts, np.uint64(0))
    two = grouped(np.add, mix(words + np.uint64(77)) * _powers(_BACK, "back", n)[place], counts, np.uint64(0))
    both = np.stack([mix(one + counts.astype(np.uint64)), mix(two)], axis=1).tobytes()
    return [both[16 * i : 16 * i + 16] if c else None for i, c in enumerate(counts)]


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value per group holding its consecutive numbers."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())]).cast(pa.binary())
