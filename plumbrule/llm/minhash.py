"""MinHash signatures, and exact comparison of the members of colliding buckets.

Rows that are compared are called nodes and have a 16-byte name, which stands for their words; equal texts are
one node.  A bucket is the set of nodes with one key in one tree (or band).  Buckets are compared inside
tasks, in blocks of bounded size, with exact set intersections; what leaves a task is one row per node, never
a pair.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.llm.steps import settle
from plumbrule.llm.text import grouped, mix

SIZE = 5
LEAST = 0.8
#: Nodes, and shingles, that one side of a comparison holds at most.
BLOCK_NODES = 512
BLOCK_SHINGLES = 500_000
UPPER_HALF = -1 << 32


@functools.lru_cache(maxsize=4)
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (drawn[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (drawn[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(shingles: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """``n`` smallest hashes of each set of shingles, one row per set; empty sets get the largest number."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    factor, shift = _seeds(n)
    out = np.empty((len(sizes), n), np.uint32)
    for i in range(n):
        out[:, i] = grouped(np.minimum, low * factor[i] + shift[i], sizes, np.uint32(0xFFFFFFFF))
    return out


def prefix_keys(signature: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One 64-bit key per tree: the first ``depth`` numbers of the tree's label."""
    labels = signature.reshape(len(signature), trees, signature.shape[1] // trees)[:, :, :depth].astype(np.uint64)
    out = np.full((len(signature), trees), 7, np.uint64)
    for i in range(depth):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + labels[:, :, i])
    return out.view(np.int64)


def list_column(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))


def unlike(known: list[tuple[str, bool]], trees: int) -> tuple[list[tuple[str, Column]], Column]:
    """Numbers of a node for the arrays of keys in ``known``, and whether the members of a bucket all share such a key.

    The numbers are ``(name, column)``; the second column reads, under the same names, the bits in which the
    members of a bucket differ.  Half of a key's bits tell keys apart inside a bucket.
    """
    upper = lambda name, t: F.col(name)[t].bitwiseAND(F.lit(UPPER_HALF))
    pair = lambda name, t: upper(name, t).bitwiseOR(F.shiftrightunsigned(F.col(name)[t + 1], 32)) if t + 1 < trees else upper(name, t)
    words = [(f"{name}_{t}", pair(name, t)) for name in dict.fromkeys(name for name, _ in known) for t in range(0, trees, 2)]
    done = F.lit(False)
    for name, lower in known:
        for t in range(trees):
            differs = F.col(f"{name}_{t // 2 * 2}").bitwiseAND(F.lit(~UPPER_HALF if t % 2 else UPPER_HALF))
            same = differs == 0
            done = done | (same & (F.col("tree") > t) if lower else same)
    return words, done


def differing(words: list[tuple[str, Column]]) -> list[Column]:
    """Aggregates over a bucket: bits that all or any members have differ where the members do."""
    return [F.bit_or(word).bitwiseXOR(F.bit_and(word)).alias(word) for word, _ in words]


def crowded(nodes: DataFrame, keys: str, known: list[tuple[str, bool]]) -> DataFrame:
    """``tree, key, members, weight`` of the buckets in which some pair has not been compared before.

    ``nodes`` has ``node``, ``n_shingles``, and arrays of keys, one key per tree.  ``known`` names arrays in
    which an equal key means "already compared"; with ``True`` this holds for lower trees only.  A bucket whose
    members all share such a key is left out.
    """
    trees = len(nodes.select(keys).first()[0])
    slots = nodes.select("node", "n_shingles", F.posexplode(keys).alias("tree", "key"))
    # only buckets with two members are looked at more closely
    several = slots.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight")).where("members > 1")
    words, done = unlike(known, trees)
    short = [column.alias(word) for word, column in words]
    rows = slots.drop("n_shingles").join(several.hint("merge"), ["tree", "key"]).join(nodes.select("node", *short).hint("merge"), "node")
    full = rows.groupBy("tree", "key", "members", "weight").agg(*differing(words))
    return full.where(~done).select("tree", "key", "members", "weight")


def _cells(nodes: DataFrame, keys: str, buckets: DataFrame) -> DataFrame:
    """One row per node and cell: a bucket too large for one comparison is cut into blocks, and each pair of blocks is a cell.

    Places are found by names and keys alone; the sets join them afterwards.
    """
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    sized = buckets.select("tree", "key", blocks.alias("blocks"))
    rows = nodes.select("node", F.posexplode(keys).alias("tree", "key")).join(sized.hint("merge"), ["tree", "key"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")
    return rows.join(nodes.hint("merge"), "node")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of distinct numbers."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1  # a number in one set only meets nothing
    column = (np.cumsum(shared) - 1)[code]
    use = shared[code]
    owner, column, width = owner[use], column[use], int(shared.sum())
    out = np.zeros((m, m), np.float32)
    step = max(256, 4_000_000 // m)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, width, step):
        a, b = np.searchsorted(column, (low, low + step))
        part = np.zeros((m, min(step, width - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each row of a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


SIMILARITY_BINS = 20
FOUND = "node binary, root binary, n_texts long, n_copies long, similar array<long>"
_FOUND = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("n_texts", pa.int64()), ("n_copies", pa.int64()), ("similar", pa.list_(pa.int64()))])


def _compare(rows: dict, tree: int, low: int, high: int, least: float, keys: str, known: list[tuple[str, bool]]) -> pa.RecordBatch | None:
    sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
    sizes = np.array([len(s) for s in sets], np.float32)
    shared = _overlaps(sets)
    jaccard = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
    linked = jaccard >= least - 1e-6
    np.fill_diagonal(linked, False)
    if low != high:  # pairs inside a block belong to another cell
        own = np.array(rows["own"])
        linked &= own[:, None] != own[None, :]
    for name, lower in known:
        matrix = np.array(rows[name])
        for t in range(tree if lower else matrix.shape[1]):
            linked &= matrix[:, t][:, None] != matrix[:, t][None, :]
    at = np.flatnonzero(linked.any(axis=1))
    if not len(at):
        return None
    linked, jaccard = linked[np.ix_(at, at)], jaccard[np.ix_(at, at)]
    root, copies = at[_roots(linked)], np.array(rows["copies"], np.int64)[at]
    upper = np.triu(linked)
    bin_of = np.clip(((jaccard - least) / (1 - least + 1e-9) * SIMILARITY_BINS).astype(int), 0, SIMILARITY_BINS - 1)
    similar = [np.bincount(bin_of[i][upper[i]], minlength=SIMILARITY_BINS).tolist() for i in range(len(at))]
    names = rows["node"]
    return pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i in at], pa.binary()), pa.array([names[i] for i in root], pa.binary()), pa.array(linked.sum(axis=1).astype(np.int64)),
         pa.array(linked.astype(np.int64) @ copies), pa.array(similar, pa.list_(pa.int64()))], schema=_FOUND,
    )


def groups_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Runs of rows with equal keys from a sorted partition, each as a dictionary of lists."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            own = tuple(c[a] for c in columns)
            if own != key and held:
                yield key, pa.Table.from_batches(held).to_pydict()
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).to_pydict()


def compare_buckets(nodes: DataFrame, keys: str, buckets: DataFrame, least: float, known: list[tuple[str, bool]]) -> DataFrame:
    """``node, root, n_texts, n_copies, similar`` for every node with a link in a bucket.

    ``root`` is a node of the same component, ``n_texts`` and ``n_copies`` count its new partners and the
    documents these stand for, ``similar`` counts its pairs with later nodes by similarity.  A pair is counted
    in one bucket only: the lowest tree in which it meets and, by ``known``, no earlier call.
    ``nodes`` has ``node, copies, shingles`` (64-bit numbers, sorted and distinct) and the arrays of keys.
    """
    arrays = list(dict.fromkeys([keys, *[name for name, _ in known]]))
    cells = _cells(nodes.select("node", "copies", "shingles", *arrays), keys, buckets)
    used = ["tree", "key", "low", "high"]
    placed = cells.repartition(*used).sortWithinPartitions(*used, "node").select("node", "copies", "shingles", "own", *arrays, *used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _, low, high), rows in groups_of(batches, used):
            found = _compare(rows, int(tree), int(low), int(high), least, keys, known)
            if found is not None:
                yield found

    return placed.mapInArrow(run, FOUND)


def label_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each connected component of ``links`` (``node, root``)."""
    from plumbrule.operators.density import components

    edges = links.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    touched = settle(edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("node")))
    return components(touched, edges) if not touched.isEmpty() else touched.withColumn("label", F.col("node"))


def shingle_sets(texts: DataFrame, wanted: DataFrame, sets_of: Callable[[pa.RecordBatch], pa.RecordBatch], more: str = "") -> DataFrame:
    """``node, shingles`` of the wanted nodes, read again from the texts that hold them.

    ``texts`` has ``doc_id, text`` and ``wanted`` has ``doc_id, node``; ``sets_of`` turns a block of texts into
    rows ``node, shingles`` and the columns that ``more`` declares.
    """
    # the wanted rows grow with the input, so they are never broadcast
    own = texts.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    found = own.mapInArrow(lambda batches: map(sets_of, batches), "node binary, shingles binary" + more)
    return found.join(wanted.select("node").distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"])


def needed_trees(depth: int, least: float, recall: float) -> int:
    """Trees that give a pair with similarity ``least`` the wanted chance to share a prefix."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - least**depth)))


def recall_at(similarity: float | np.ndarray, depth: int, trees: int):
    return 1 - (1 - similarity**depth) ** trees

