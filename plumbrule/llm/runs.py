"""Sorted runs of 64-bit hashes: how large counts travel between tasks, and how they are kept and searched.

A task packs what it counted into one run per shard: sorted keys, their bytes laid out by significance and
compressed, so that the leading bytes cost nearly nothing.  A shard's runs are merged in the task that owns the
shard, which writes sorted arrays to the shared folder.  Workers memory-map these and search them; pages that
no search touches are never read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbrule.core.session import shared_folder
from plumbrule.llm.text import mix

#: Memory maps that one worker keeps open.
OPEN_SHARDS = 4096


def pack(*columns: np.ndarray) -> bytes:
    """Numbers of 64 bits, column after column, byte planes compressed."""
    return b"".join(
        len(body).to_bytes(8, "little") + body
        for column in columns
        for body in (pa.compress(np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True),)
    )


def unpack(body: bytes, rows: int, columns: int) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(columns):
        size = int.from_bytes(body[at : at + 8], "little")
        planes = np.frombuffer(pa.decompress(body[at + 8 : at + 8 + size], 8 * rows, "zstd", asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(8, rows).T).view("<u8").ravel())
        at += 8 + size
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)


def dealt(place: np.ndarray, sort: np.ndarray, columns: Sequence[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(shard, rows, packed run) of every shard that occurs; a run is sorted by ``sort``."""
    order = np.lexsort((sort, place))
    shards, first = np.unique(place[order], return_index=True)
    for shard, begin, end in zip(shards, first, np.append(first[1:], len(order))):
        rows = order[begin:end]
        yield int(shard), len(rows), pack(*[c[rows] for c in columns])


def merged(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(sorted different keys, sums of the columns by key, a place where each key stands)."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    added = [np.add.reduceat(s[order], first) if len(first) else s[:0] for s in sums]
    return keys[first], added, order[first]


def by_shard(runs: DataFrame, shards: int) -> DataFrame:
    """Rows of ``shard, ...`` brought to the tasks that own the shards, each shard in one piece."""
    return runs.repartition(shards, "shard").sortWithinPartitions("shard")


def shard_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one shard at a time, from batches sorted by ``shard``."""
    held: list[pa.RecordBatch] = []
    shard = None
    for batch in batches:
        numbers = batch.column(batch.schema.get_field_index("shard")).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])[: len(numbers)])
        for begin, end in zip(starts, np.append(starts[1:], len(numbers))):
            if held and shard != numbers[begin]:
                yield shard, pa.Table.from_batches(held)
                held = []
            shard = int(numbers[begin])
            held.append(batch.slice(begin, end - begin))
    if held:
        yield shard, pa.Table.from_batches(held)


def unpacked(rows: pa.Table, columns: int) -> list[np.ndarray]:
    """All runs of a shard, one after another."""
    parts = [unpack(body, n, columns) for body, n in zip(rows.column("body").to_pylist(), rows.column("n").to_pylist())]
    return [np.concatenate([p[i] for p in parts]) for i in range(columns)]


def array_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, as a path that tasks can map into memory."""
    where = urlparse(shared_folder(spark))
    if where.scheme not in ("", "file"):
        raise RuntimeError("memory-mapped arrays need spark.checkpoint.dir on a file system that all workers have mounted")
    folder = os.path.join(where.path, f"arrays-{uuid.uuid4().hex}")
    os.makedirs(folder, exist_ok=True)
    return folder


def write_array(folder: str, name: str, shard: int, values: np.ndarray) -> None:
    """Write counts in the narrowest type that holds them, keys as they are.

    The file is renamed when it is whole, so that a task that is run again or twice leaves one good file.
    """
    if values.dtype != np.uint64:
        values = values.astype(next(kind for kind in ("<u1", "<u2", "<u4", "<u8") if values.max(initial=0) <= np.iinfo(kind).max))
    path = os.path.join(folder, f"{name}-{shard}")
    new = f"{path}.{uuid.uuid4().hex}"
    with open(new, "wb") as out:
        out.write(values.tobytes())
        out.flush()
        os.fsync(out.fileno())
    os.replace(new, path)


class MappedArrays:
    """Sorted hash arrays in a folder: for every key the counts stored beside it, 0 where it is absent."""

    def __init__(self, folder: str, name: str, values: Sequence[str], shards: int):
        self.folder, self.name, self.values, self.shards = folder, name, values, shards
        self._open: dict[int, tuple] = {}

    def __reduce__(self):
        return MappedArrays, (self.folder, self.name, self.values, self.shards)

    def _map(self, name: str, shard: int, rows: int | None = None) -> np.ndarray:
        path = os.path.join(self.folder, f"{name}-{shard}")
        if not os.path.exists(path) or not os.path.getsize(path):
            return np.zeros(0, np.uint64)
        return np.memmap(path, "<u8" if rows is None else f"<u{os.path.getsize(path) // rows}", "r")

    def shard(self, shard: int) -> tuple[np.ndarray, list[np.ndarray]]:
        if shard not in self._open:
            if len(self._open) >= OPEN_SHARDS:
                self._open.pop(next(iter(self._open)))
            keys = self._map(self.name, shard)
            self._open[shard] = keys, [self._map(f"{self.name}.{v}", shard, len(keys)) for v in self.values]
        return self._open[shard]

    def find(self, keys: np.ndarray, place: np.ndarray | None = None) -> list[np.ndarray]:
        """Values of sorted different keys; ``place`` are their shards where these do not follow from the keys."""
        out = [np.zeros(len(keys), np.int64) for _ in self.values]
        place = shard_of(keys, self.shards) if place is None else place
        order = np.argsort(place, kind="stable")
        shards, first = np.unique(place[order], return_index=True)
        for shard, begin, end in zip(shards, first, np.append(first[1:], len(order))):
            known, values = self.shard(int(shard))
            if not len(known):
                continue
            rows = order[begin:end]
            at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
            there = known[at] == keys[rows]
            for o, v in zip(out, values):
                o[rows[there]] = v[at[there]]
        return out
