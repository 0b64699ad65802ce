"""Rows of one or two numbers: exact neighbours by the larger gap, and sums of distances, without all pairs.

A k-d tree over a hashed sample cuts the rows into blocks of bounded size; every block travels as one row of packed
numbers.  A query finds its neighbours in its own block first and then visits only the blocks whose box its k-th
distance reaches.  Sums of distances come from a fast multipole scheme (Greengard and Rokhlin, 1987; with
interpolation at Chebyshev nodes, Fong and Darve, 2009): rows that are near are measured pair by pair, and between
boxes that lie apart the distance is a polynomial, right to ``1e-10`` of itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrule.core.session import cut_lineage

#: Rows of a block, blocks that the driver lists, rows of the sample for every block.
BLOCK_ROWS = 16_384
BLOCKS = 1024
SAMPLED = 64
#: Numbers of a table of moments that the driver sends to the tasks.
MOMENT_NUMBERS = 8_000_000
#: Rows of a leaf inside a block, for neighbours and for sums.
NEAR_LEAF = 64
SUM_LEAF = 256
#: Nodes of an axis, and half widths that lie between boxes whose distances are a polynomial.
NODES = 14
APART = 2.0


@dataclass(frozen=True)
class Splits:
    """k-d trees, one for every group: rows go right where their number is beyond the cut."""

    group: np.ndarray
    root: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    block: np.ndarray

    def of(self, g: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Block of every row, -1 for a group without points."""
        if not len(self.group):
            return np.full(len(x), -1, np.int32)
        at = np.minimum(np.searchsorted(self.group, g), len(self.group) - 1)
        node, every = self.root[at], np.arange(len(x))
        while (inner := self.left[node] >= 0).any():
            beyond = x[every, self.axis[node]] > self.cut[node]
            node = np.where(inner, np.where(beyond, self.right[node], self.left[node]), node)
        return np.where(self.group[at] == g, self.block[node], -1).astype(np.int32)


def split(points: DataFrame, block_rows: int | None = None) -> Splits:
    """Cuts of ``id, g, v`` into blocks of about ``block_rows`` rows, from a sample by the hash of the id."""
    count = {r["g"]: r["n"] for r in points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(count.values())
    block_rows = max(block_rows or BLOCK_ROWS, n // BLOCKS)
    share = min(1.0, SAMPLED / block_rows)
    some = points.where(F.xxhash64(F.lit(23), "id").cast("double") / 2.0**64 + 0.5 < share).select("g", "v").toPandas()
    axis, cut, left, right, block, root = [], [], [], [], [], []

    def node() -> int:
        for column in (left, right, block):
            column.append(-1)
        axis.append(0)
        cut.append(0.0)
        return len(axis) - 1

    blocks = 0
    for g in sorted(count):
        own = np.array(some["v"][some["g"] == g].tolist(), float)
        rows = count[g] / max(len(own), 1)
        root.append(node())
        left_over = [(root[-1], own)]
        while left_over:
            at, x = left_over.pop()
            width = x.max(axis=0) - x.min(axis=0) if len(x) > 1 else np.zeros(1)
            if len(x) * rows <= block_rows or not width.max() > 0:
                block[at] = blocks
                blocks += 1
                continue
            axis[at] = int(width.argmax())
            values = np.sort(x[:, axis[at]])
            middle = values[(len(values) - 1) // 2]
            cut[at] = float(middle if middle < values[-1] else values[values < values[-1]][-1])
            beyond = x[:, axis[at]] > cut[at]
            left[at], right[at] = node(), node()
            left_over += [(right[at], x[beyond]), (left[at], x[~beyond])]
    numbers = [np.array(c, t) for c, t in ((sorted(count), np.int64), (root, np.int64), (axis, np.int64), (cut, float), (left, np.int64), (right, np.int64), (block, np.int64))]
    return Splits(*numbers)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def _numbers(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(), dtype=kind)


def _floats(blob: bytes, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(blob, float)
    return out if width is None else out.reshape(-1, width)


def place(points: DataFrame, splits: Splits) -> DataFrame:
    """Add ``block`` to rows with ``g`` and ``v``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                block = splits.of(column["g"].to_numpy(zero_copy_only=False), _vectors(column["v"]))
                yield pa.RecordBatch.from_pydict(column | {"block": pa.array(block, pa.int32())})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(work, f"{schema}, block int").where("block >= 0")


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, first row of every leaf): halves by the wider axis down to ``size`` rows."""
    order, starts, parts = np.arange(len(x)), [], [(0, len(x))]
    while parts:
        begin, end = parts.pop()
        if end - begin <= size:
            starts.append(begin)
            continue
        own = x[order[begin:end]]
        axis, half = (own.max(axis=0) - own.min(axis=0)).argmax(), (end - begin) // 2
        order[begin:end] = order[begin:end][np.argpartition(own[:, axis], half)]
        parts += [(begin + half, end), (begin, begin + half)]
    return order, np.array(starts)


def _largest_gap(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.abs(q[:, 0, None] - p[None, :, 0])
    for i in range(1, q.shape[1]):
        np.maximum(out, np.abs(q[:, i, None] - p[None, :, i]), out=out)
    return out


def near_in_block(q: np.ndarray, limit: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of neighbours of every query, their ids and distances): the ``k`` nearest within ``limit``, ties to the smaller id."""
    order, starts = _leaves(p, NEAR_LEAF)
    p, ids, ends = p[order], ids[order], np.append(starts[1:], len(p))
    low, high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
    asked, begins = _leaves(q, NEAR_LEAF)
    found, count = [], np.zeros(len(q), np.int64)
    for begin, end in zip(begins, np.append(begins[1:], len(q))):
        rows = asked[begin:end]
        own, most = q[rows], limit[rows]
        gap = np.maximum(np.maximum(low - own.max(axis=0), own.min(axis=0) - high).max(axis=1), 0.0)
        if np.isinf(most).any() and k <= len(p):
            near = np.argsort(gap, kind="stable")
            near = near[: max(2, int((np.cumsum(ends[near] - starts[near]) < k).sum()) + 1)]
            d = _largest_gap(own, np.concatenate([p[starts[j] : ends[j]] for j in near]))
            most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
        near = np.flatnonzero(gap <= most.max())
        if not len(near):
            continue
        names = np.concatenate([ids[starts[j] : ends[j]] for j in near])
        d = _largest_gap(own, np.concatenate([p[starts[j] : ends[j]] for j in near]))
        row, column = np.nonzero(d <= most[:, None])
        distance, name = d[row, column], names[column]
        best = np.lexsort((name, distance, row))
        ordered = row[best]
        best = best[np.arange(len(ordered)) - np.searchsorted(ordered, ordered) < k]
        count[rows] = np.bincount(row[best], minlength=len(rows))
        found.append((rows[row[best]], name[best], distance[best]))
    if not found:
        return count, np.zeros(0, np.int64), np.zeros(0)
    row, name, distance = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(row, kind="stable")
    return count, name[order], distance[order]


def _packed(rows: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """A row for every ``block`` and ``part``: ``n``, the box ``low, high`` and the packed columns ``ids, x`` and ``kth``."""
    rows = rows.withColumn("part", F.lit(0)) if parts is None else rows.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    limited = "kth" in rows.columns

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        x = _vectors(rows.column("v"))
        kth = _numbers(rows.column("kth"), float).tobytes() if limited else None
        cells = {"block": key[0], "part": key[1], "g": rows.column("g")[0], "n": len(x), "low": x.min(axis=0).tolist(), "high": x.max(axis=0).tolist(), "ids": _numbers(rows.column("id"), np.int64).tobytes(), "x": x.tobytes(), "kth": kth}
        return pa.Table.from_pylist([{c: v.as_py() if isinstance(v, pa.Scalar) else v for c, v in cells.items()}], schema=_PACKED)

    kept = rows.select("block", "part", "g", "id", "v", *(["kth"] if limited else []))
    return kept.groupBy("block", "part").applyInArrow(work, "block int, part int, g int, n long, low array<double>, high array<double>, ids binary, x binary, kth binary")


_PACKED = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("g", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("x", pa.binary()), ("kth", pa.binary())])
_BEST = pa.struct([("distance", pa.float64()), ("neighbour", pa.int64())])


@dataclass(frozen=True)
class Boxes:
    """Box, group and rows of every block of points."""

    block: np.ndarray
    group: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def reached(self, g: int, own: int, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block) of the visits of queries whose ``own`` block has been met, and how far each query looks."""
        mine = np.flatnonzero(self.group == g)
        open_rows = np.flatnonzero(np.isinf(kth))
        if len(open_rows) and self.rows[mine].sum() >= k:
            kth = kth.copy()
            for at in range(0, len(open_rows), 1024):
                some = q[open_rows[at : at + 1024], None, :]
                high = np.maximum(np.abs(some - self.low[mine]), np.abs(some - self.high[mine])).max(axis=2)
                order = np.argsort(high, axis=1)
                enough = (np.cumsum(self.rows[mine][order], axis=1) < k).sum(axis=1)
                kth[open_rows[at : at + 1024]] = np.take_along_axis(high, order, 1)[np.arange(len(some)), enough]
        # blocks near the queries as a whole, then near each of them
        most = kth.max()
        near = mine[(np.maximum(self.low[mine] - q.max(axis=0), q.min(axis=0) - self.high[mine]).max(axis=1) <= most) & (self.block[mine] != own)]
        row, block = [], []
        for j in near:
            hit = np.flatnonzero(np.maximum(self.low[j] - q, q - self.high[j]).max(axis=1) <= kth)
            row.append(hit)
            block.append(np.full(len(hit), self.block[j]))
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *row]), np.concatenate([empty, *block]), kth


def search(queries: DataFrame, points: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """``id, best``: the k nearest points of the query's group by the larger gap, as sorted (distance, neighbour).

    Both inputs are ``id, g, v`` with finite numbers.  Queries whose group has no point are left out.
    """
    splits = split(points, block_rows)
    targets = cut_lineage(_packed(place(points, splits)))
    table = targets.select("block", "g", "low", "high", "n").orderBy("block").toPandas()
    boxes = Boxes(table["block"].to_numpy(), table["g"].to_numpy(), *(np.array(table[c].tolist(), float) for c in ("low", "high")), table["n"].to_numpy())
    width = boxes.low.shape[1] if len(table) else 1
    packed_points = targets.select("block", F.col("ids").alias("p_ids"), F.col("x").alias("p_x"))
    size = block_rows or BLOCK_ROWS

    def met(asked: DataFrame, first: bool) -> DataFrame:
        parts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (2 * max(size, NEAR_LEAF))).cast("int").alias("parts"))
        visits = cut_lineage(_packed(asked, parts))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for one in batch.to_pylist():
                    ids, x, q = np.frombuffer(one["p_ids"], np.int64), _floats(one["p_x"], width), _floats(one["x"], width)
                    limit = np.full(len(q), np.inf) if first else _floats(one["kth"])
                    count, name, distance = near_in_block(q, limit, x, ids, k)
                    ends = np.cumsum(count)
                    cells = {"id": pa.array(np.frombuffer(one["ids"], np.int64)), "best": _lists(ends, pa.StructArray.from_arrays([pa.array(distance), pa.array(name)], fields=list(_BEST)))}
                    if first:
                        kth = np.full(len(q), np.inf)
                        kth[count >= k] = distance[ends[count >= k] - 1]
                        row, block, kth = boxes.reached(one["g"], one["block"], q, kth, k)
                        order = np.argsort(row, kind="stable")
                        more = _lists(np.cumsum(np.bincount(row, minlength=len(q))), pa.array(block[order].astype(np.int32)))
                        cells |= {"g": pa.array(np.full(len(q), one["g"], np.int32)), "v": _lists(np.arange(1, len(q) + 1) * width, pa.array(q.ravel())), "kth": pa.array(kth), "more": more}
                    yield pa.RecordBatch.from_pydict(cells)

        best = "id long, best array<struct<distance:double,neighbour:bigint>>"
        both = visits.join(packed_points, "block").select("block", "g", "ids", "x", "kth", "p_ids", "p_x")
        dealt = both.repartition(max(1, min(BLOCKS, visits.count())), "block", F.xxhash64("ids"))
        return dealt.mapInArrow(work, f"{best}, g int, v array<double>, kth double, more array<int>" if first else best)

    own = cut_lineage(met(place(queries.select("id", "g", "v"), splits), True))
    visits = own.where(F.size("more") > 0).select("id", "g", "v", "kth", F.explode("more").alias("block"))
    added = met(visits, False).groupBy("id").agg(F.flatten(F.collect_list("best")).alias("added"))
    joined = own.where(F.size("more") > 0).select("id", "best").join(added, "id", "left")
    merged = joined.select("id", F.slice(F.array_sort(F.concat("best", F.coalesce("added", F.slice("best", 1, 0)))), 1, k).alias("best"))
    return own.where(F.size("more") == 0).select("id", "best").unionByName(merged)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


class Tree:
    """Halves of the rows of a block down to leaves; parents come before their children."""

    def __init__(self, x: np.ndarray, leaf: int = 0):
        order, self.begin, self.end, self.left, self.right = np.arange(len(x)), [0], [len(x)], [-1], [-1]
        at = 0
        while at < len(self.begin):
            begin, end = self.begin[at], self.end[at]
            if end - begin > (leaf or SUM_LEAF):
                own, half = x[order[begin:end]], (end - begin) // 2
                axis = (own.max(axis=0) - own.min(axis=0)).argmax()
                order[begin:end] = order[begin:end][np.argpartition(own[:, axis], half)]
                self.left[at], self.right[at] = len(self.begin), len(self.begin) + 1
                self.begin += [begin, begin + half]
                self.end += [begin + half, end]
                self.left += [-1, -1]
                self.right += [-1, -1]
            at += 1
        self.order, self.x = order, x[order]
        self.low = np.array([self.x[a:b].min(axis=0) for a, b in zip(self.begin, self.end)])
        self.high = np.array([self.x[a:b].max(axis=0) for a, b in zip(self.begin, self.end)])
        self.middle, self.half = ((self.low + self.high) / 2).tolist(), ((self.high - self.low) / 2).tolist()
        self.size = [max(h) for h in self.half]
        self.nodes = [nodes(a, b) for a, b in zip(self.low, self.high)]

    def moments(self, weights: np.ndarray) -> list[np.ndarray]:
        """Weights at the nodes of every box that act from afar as the rows of the box."""
        out: list[np.ndarray] = [np.zeros(0)] * len(self.begin)
        for at in range(len(out) - 1, -1, -1):
            low, high = self.low[at], self.high[at]
            if self.left[at] < 0:
                out[at] = basis(self.x[self.begin[at] : self.end[at]], low, high).T @ weights[self.begin[at] : self.end[at]]
            else:
                out[at] = sum(basis(self.nodes[c], low, high).T @ out[c] for c in (self.left[at], self.right[at]))
        return out


_CHEBYSHEV = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
_AT_NODES = np.cos(np.arange(NODES)[:, None] * np.arccos(_CHEBYSHEV)[None, :]) * np.where(np.arange(NODES) > 0, 2.0, 1.0)[:, None] / NODES


def nodes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Chebyshev nodes of a box, one row each."""
    axes = [(a + b) / 2 + (b - a) / 2 * _CHEBYSHEV for a, b in zip(low, high)]
    return np.stack([c.ravel() for c in np.meshgrid(*axes, indexing="ij")], axis=1)


def basis(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Value at every row of the polynomial that is 1 at one node of the box and 0 at the others."""
    out = np.ones((len(x), 1))
    for i, (a, b) in enumerate(zip(low, high)):
        t = np.clip((x[:, i] - (a + b) / 2) / ((b - a) / 2), -1.0, 1.0) if b > a else np.zeros(len(x))
        own = np.cos(np.arccos(t)[:, None] * np.arange(NODES)) @ _AT_NODES
        out = (out[:, :, None] * own[:, None, :]).reshape(len(x), -1)
    return out


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.subtract.outer(q[:, 0], p[:, 0])
    if q.shape[1] == 1:
        return np.abs(out, out=out)
    np.multiply(out, out, out=out)
    other = np.subtract.outer(q[:, 1], p[:, 1])
    out += np.multiply(other, other, out=other)
    return np.sqrt(out, out=out)


def _gap(a: Sequence[float], b: Sequence[float], half_a: Sequence[float], half_b: Sequence[float]) -> float:
    return math.hypot(*[max(0.0, abs(x - y) - h - k) for x, y, h, k in zip(a, b, half_a, half_b)])


def distance_sums(target: Tree, sources: Sequence[tuple[Tree, np.ndarray]], far: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """For every row of ``target.x`` the weighted sums of its distances to the rows of the sources, a column for each weight.

    ``far`` are nodes and moments of boxes apart from the whole target.
    """
    width = sources[0][1].shape[1] if sources else far[1].shape[1]
    many = NODES ** target.x.shape[1]
    out, local = np.zeros((len(target.x), width)), [None] * len(target.begin)
    if far is not None and len(far[0]):
        local[0] = sum(_distances(target.nodes[0], far[0][at : at + 4096]) @ far[1][at : at + 4096] for at in range(0, len(far[0]), 4096))
    near, apart = {}, {}
    for source, weights in sources:
        pairs = [(0, 0)]
        while pairs:
            a, b = pairs.pop()
            size_a, size_b = target.size[a], source.size[b]
            rows_a, rows_b = target.end[a] - target.begin[a], source.end[b] - source.begin[b]
            if _gap(target.middle[a], source.middle[b], target.half[a], source.half[b]) >= APART * max(size_a, size_b) and max(size_a, size_b) > 0 and rows_a * rows_b > many * many:
                apart.setdefault(a, []).append((source, weights, b))
            elif target.left[a] < 0 and source.left[b] < 0:
                near.setdefault(a, []).append((source, weights, b))
            elif source.left[b] < 0 or (target.left[a] >= 0 and size_a >= size_b):
                pairs += [(target.left[a], b), (target.right[a], b)]
            else:
                pairs += [(a, source.left[b]), (a, source.right[b])]
    moments = {id(s): s.moments(w) for s, w in sources if any(s is x for seen in apart.values() for x, _, _ in seen)}
    for a in range(len(target.begin)):
        for at in range(0, len(apart.get(a, [])), 32):
            some = apart[a][at : at + 32]
            seen = _distances(target.nodes[a], np.concatenate([s.nodes[b] for s, _, b in some])) @ np.concatenate([moments[id(s)][b] for s, _, b in some])
            local[a] = seen if local[a] is None else local[a] + seen
        rows = slice(target.begin[a], target.end[a])
        if target.left[a] >= 0:
            for child in (target.left[a], target.right[a]) if local[a] is not None else ():
                passed = basis(target.nodes[child], target.low[a], target.high[a]) @ local[a]
                local[child] = passed if local[child] is None else local[child] + passed
        elif local[a] is not None:
            out[rows] += basis(target.x[rows], target.low[a], target.high[a]) @ local[a]
        for at in range(0, len(near.get(a, [])), 16):
            some = near[a][at : at + 16]
            d = _distances(target.x[rows], np.concatenate([s.x[s.begin[b] : s.end[b]] for s, _, b in some]))
            out[rows] += d @ np.concatenate([w[s.begin[b] : s.end[b]] for s, w, b in some])
    return out


def _members(codes: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Weight of every row for every cluster of every labelling."""
    out = np.zeros((len(codes), width))
    for i in range(codes.shape[1]):
        out[np.arange(len(codes)), codes[:, i]] = n
    return out


def mean_silhouettes(points: DataFrame, starts: Sequence[int], block_rows: int | None = None) -> list[float]:
    """Mean silhouette of every labelling of different ``id, v, labels, n, weight`` with finite numbers.

    Labelling i has the clusters ``starts[i]`` to ``starts[i + 1]``.  Blocks that lie apart meet by their moments,
    the others travel to one another.
    """
    width, models, rows = starts[-1], len(starts) - 1, points.count()
    axes = len(points.first()["v"])
    many = NODES**axes
    splits = split(points.withColumn("g", F.lit(0)), max(block_rows or BLOCK_ROWS, rows * many * width // MOMENT_NUMBERS))
    shift = np.array(starts[:-1], np.int64)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.lexsort(_vectors(rows.column("v")).T)
        x, codes = _vectors(rows.column("v"))[order], _vectors(rows.column("labels")).astype(np.int64)[order] + shift
        n, weight = _numbers(rows.column("n"), float)[order], _numbers(rows.column("weight"), float)[order]
        members, low, high = _members(codes, n, width), x.min(axis=0), x.max(axis=0)
        moments = sum(basis(x[at : at + 4096], low, high).T @ members[at : at + 4096] for at in range(0, len(x), 4096))
        cells = {"block": key[0].as_py(), "low": low.tolist(), "high": high.tolist(), "counts": members.sum(axis=0).tolist(), "moments": moments.tobytes(), "x": x.tobytes(), "codes": codes.astype(np.int32).tobytes(), "n": n.tobytes(), "weight": weight.tobytes()}
        return pa.Table.from_pylist([cells])

    placed = place(points.withColumn("g", F.lit(0)), splits).select("block", "v", "labels", "n", "weight")
    packed = cut_lineage(placed.groupBy("block").applyInArrow(pack, "block long, low array<double>, high array<double>, counts array<double>, moments binary, x binary, codes binary, n binary, weight binary"))
    table = packed.select("block", "low", "high", "counts", "moments").orderBy("block").collect()
    low, high = (np.array([r[c] for r in table]) for c in ("low", "high"))
    count = np.array([r["counts"] for r in table]).sum(axis=0)
    names = [r["block"] for r in table]
    spots, moments = [nodes(a, b) for a, b in zip(low, high)], [_floats(bytes(r["moments"]), width) for r in table]
    half = ((high - low) / 2).max(axis=1)
    gap = np.sqrt((np.maximum(np.maximum(low[:, None] - high[None], low[None] - high[:, None]), 0.0) ** 2).sum(axis=2))
    # a block whose rows all lie at one spot is no polynomial of its own width
    apart = (gap >= APART * np.maximum(half[:, None], half[None])) & (gap > 0)
    pairs = [(names[a], names[b]) for a, b in zip(*np.nonzero(~apart))]

    def scores(key: tuple, rows: pa.Table) -> pa.Table:
        own, sources, target = key[0].as_py(), [], None
        for r in sorted(rows.to_pylist(), key=lambda r: r["block"]):
            tree = Tree(_floats(r["x"], axes))
            codes, n = np.frombuffer(r["codes"], np.int32).reshape(-1, models)[tree.order], _floats(r["n"])[tree.order]
            sources.append((tree, _members(codes, n, width)))
            if r["block"] == own:
                target, mine, weight = tree, codes, _floats(r["weight"])[tree.order]
        far = np.flatnonzero(apart[names.index(own)])
        sent = (np.concatenate([spots[j] for j in far]), np.concatenate([moments[j] for j in far])) if len(far) else None
        sums, found = distance_sums(target, sources, sent), []
        for i in range(models):
            cells = np.arange(starts[i], starts[i + 1])
            at, code = np.arange(len(sums)), mine[:, i]
            others = np.divide(sums[:, cells], count[cells], out=np.full((len(sums), len(cells)), np.inf), where=count[cells] > 0)
            others[at, code - starts[i]] = np.inf
            b, alone = others.min(axis=1), count[code] <= 1
            a = sums[at, code] / np.where(alone, 1.0, count[code] - 1)
            most = np.maximum(a, b)
            fair = ~alone & np.isfinite(b) & (most > 0)
            found.append(float(((b - a)[fair] / most[fair]) @ weight[fair]))
        return pa.Table.from_pylist([{"scores": found, "weight": float(weight.sum())}])

    visits = points.sparkSession.createDataFrame([(int(a), int(b)) for a, b in pairs], "target long, block long")
    met = visits.join(packed.select("block", "x", "codes", "n", "weight"), "block").repartition(len(names), "target")
    found = met.groupBy("target").applyInArrow(scores, "scores array<double>, weight double").collect()
    whole = sum(r["weight"] for r in found)
    return [math.fsum(r["scores"][i] for r in found) / whole for i in range(models)]
