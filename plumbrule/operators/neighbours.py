"""Distances between rows: exact nearest neighbours and class-wise sums, by way of a pivot table.

Points go to the nearest of some hashed pivots.  A cell is cut into rings by the distance to its pivot, and a
ring that holds too many rows into parts, so that a block has a bounded number of rows; the table of blocks
(pivot, least and largest distance, rows) is small.  By the triangle inequality it bounds the distance from a
query to every block.  A query visits blocks in the order of that bound, one, then four, then sixteen more,
until the next bound lies beyond its k-th distance.  Points are never copied to blocks they do not belong to;
a query travels only to the blocks that it visits, and a block with many visitors is cut up by visitor.

Equal vectors are searched once, whatever their number.  Rows without a vector take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.core.session import cut_lineage
from plumbrule.operators import plane

#: Rows of a block, and visitors of one task of a block.
BLOCK_ROWS = 4096
VISITORS = 4096
#: Pivots, blocks and numbers of a label table that one task keeps; blocks grow with the table beyond that.
PIVOTS = 2048
BLOCKS = 100_000
LABEL_NUMBERS = 8_000_000
RINGS = 64
CHUNK = 64
#: Rounding room of a bound.
SLACK = 1e-9
#: Dimensions up to which distances are added up column by column; squared distances, for the squared norms, that are measured again.
FEW_DIMENSIONS = 8
CLOSE = 1e-4
#: Points and visitors of one task where bounds spare little; distances that a task holds at once.
WIDE_ROWS = 32_768
#: Blocks that a query has visited when it is seen whether the bounds spare much; more than four times as many must be there.
MANY_VISITED = 5
CELLS = 1 << 20
#: Rows of one or two numbers beyond which they are cut by a k-d tree.
PLANE_ROWS = 32_768
#: Squared norms up to which single precision has room to spare, and its largest number.
SINGLE = 1e30
FLOAT_MOST = float(np.finfo(np.float32).max)

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def vector(df: DataFrame, features: Sequence[str] | str) -> Column:
    """One array<double> from an array column or from several numeric columns."""
    if isinstance(features, str):
        return F.col(quoted(features)).cast("array<double>")
    return F.array(*[F.col(quoted(c)).cast("double") for c in features])


def _by_differences(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(p)))
    for at in range(0, len(q), CHUNK):
        gap = q[at : at + CHUNK, None, :] - p[None, :, :]
        out[at : at + CHUNK] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def pair_distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of ``q`` to the row of ``p`` beside it."""
    gap = q - p
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _listed_distances(q: np.ndarray, p: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """:func:`pair_distances` of the listed rows, some at a time."""
    step = max(1, CELLS // max(q.shape[1], 1))
    return np.concatenate([np.zeros(0), *[pair_distances(q[row[at : at + step]], p[column[at : at + step]]) for at in range(0, len(row), step)]])


def _may_be_near(q: np.ndarray, p: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, column) of all pairs within ``limit``, or with an infinite limit of all that may be among the ``k`` nearest; a few more.

    Squared distances are a product of matrices in single precision.  ``room`` is twice what rounding of the
    operands, the product over the dimensions and the sums may add up to, so no pair is lost; the caller measures
    the pairs again.  None where single precision does not hold the numbers.
    """
    centre = p.mean(axis=0)
    a, b = q - centre, p - centre
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    if not (aa.max(initial=0.0) < SINGLE and bb.max(initial=0.0) < SINGLE):
        return None
    dimensions = q.shape[1] + 10
    room = 2 * dimensions * (2.0**-24 * (aa + bb.max(initial=0.0)) + 1e-37)
    squares = a.astype(np.float32) @ (-2.0 * b.T).astype(np.float32)
    squares += aa.astype(np.float32)[:, None]
    squares += bb.astype(np.float32)[None, :]
    edge = limit * limit * (1 + 4 * SLACK) + room
    open_rows = np.isinf(limit)
    if open_rows.any() and k < len(p):
        edge[open_rows] = np.partition(squares[open_rows], k - 1, axis=1)[:, k - 1] + 2 * room[open_rows]
    # the edge is rounded up, so that single precision does not pull it in
    edge = np.nextafter(np.minimum(edge, FLOAT_MOST).astype(np.float32), np.float32(np.inf))
    return np.nonzero(squares <= edge[:, None])


def euclidean(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """All distances, column by column in few dimensions, else by a product of matrices.

    The product loses digits where rows are close for their size, so those pairs are measured again by their
    differences; every distance is right to some ``SLACK`` of itself, and equal rows are at 0.
    """
    if q.shape[1] <= FEW_DIMENSIONS:
        out, gap = np.zeros((len(q), len(p))), np.empty((min(CHUNK, len(q)), len(p)))
        for at in range(0, len(q), CHUNK):
            part = out[at : at + CHUNK]
            for i in range(q.shape[1]):
                own = np.subtract(q[at : at + CHUNK, i, None], p[None, :, i], out=gap[: len(part)])
                part += np.multiply(own, own, out=own)
            np.sqrt(part, out=part)
        return out
    centre = p.mean(axis=0) if len(p) else 0.0
    a, b = q - centre, p - centre
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    if not (np.isfinite(aa).all() and np.isfinite(bb).all()):
        return _by_differences(q, p)
    out = a @ (-2.0 * b.T)
    out += aa[:, None]
    out += bb[None, :]
    largest = bb.max(initial=0.0)
    for at in range(0, len(q), CHUNK):
        part = out[at : at + CHUNK]
        close, column = np.nonzero(part <= CLOSE * (aa[at : at + CHUNK, None] + largest))
        if len(close):
            gap = q[at + close] - p[column]
            part[close, column] = np.einsum("ij,ij->i", gap, gap)
        np.sqrt(part, out=part)
    return out


def chebyshev(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(p)))
    for i in range(q.shape[1]):
        np.maximum(out, np.abs(q[:, i, None] - p[None, :, i]), out=out)
    return out


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=float)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Columns of the ``n`` least values of every row, in order; the smaller column first on ties."""
    if n >= values.shape[1]:
        return np.argsort(values, axis=1, kind="stable")
    edge = np.partition(values, n - 1, axis=1)[:, n - 1 : n]
    # with a NaN at the edge every value may be asked for
    row, column = np.nonzero((values <= edge) | np.isnan(edge))
    order = np.lexsort((column, values[row, column], row))
    row, column = row[order], column[order]
    at = np.arange(len(row)) - np.searchsorted(row, row)
    return column[at < n].reshape(len(values), n)


@dataclass(frozen=True)
class Pivots:
    """Pivots with their groups, and the blocks: number of the pivot, distances to it, rows."""

    points: np.ndarray
    group: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    metric: Metric

    def bounds(self, group: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(blocks of the group, least and largest possible distance from every query to them)."""
        own = np.flatnonzero(self.group[self.cell] == group)
        pivots, place = np.unique(self.cell[own], return_inverse=True)
        d = self.metric(q, self.points[pivots])[:, place]
        low = np.maximum(np.maximum(d - self.high[own], self.low[own] - d), 0.0)
        return own, low - SLACK * (d + self.low[own]), (d + self.high[own]) * (1 + SLACK)

    def merged(self, rows: int) -> np.ndarray:
        """For every block the number of the wide block, of about ``rows`` rows of one group, that it is part of."""
        group, out, base = self.group[self.cell], np.zeros(len(self.cell), np.int64), 0
        for one in np.unique(group):
            own = np.flatnonzero(group == one)
            out[own] = base + (np.cumsum(self.rows[own]) - self.rows[own]) // rows
            base = out[own].max() + 1
        return out


def _in_wide_blocks(points: DataFrame, number: np.ndarray) -> DataFrame:
    names = points.sparkSession.createDataFrame([(i, int(w)) for i, w in enumerate(number)], "block int, wide int")
    return points.join(F.broadcast(names), "block").withColumn("block", F.col("wide")).drop("wide")


def _choose(points: DataFrame, n: int, block_rows: int) -> pd.DataFrame:
    """Pivots by hash, at least one of every group; bounded by ``PIVOTS`` and the number of groups."""
    wanted = min(PIVOTS, math.ceil(n / block_rows))
    hashed = points.select("g", "v", "id", F.xxhash64(F.lit(17), "id").alias("h"))
    some = hashed.orderBy("h", "id").limit(wanted)
    least = hashed.groupBy("g").agg(F.min_by(F.struct("v", "id", "h"), F.struct("h", "id")).alias("p")).select("g", "p.v", "p.id", "p.h")
    return some.unionByName(least).dropDuplicates(["id"]).orderBy("g", "h", "id").select("g", "v").toPandas()


def _whole(points: DataFrame, n: int, metric: Metric) -> tuple[DataFrame, Pivots]:
    """One block for every group of a small table."""
    groups = np.array(sorted(r["g"] for r in points.select("g").distinct().collect()), np.int64)
    number = F.array_position(F.array(*[F.lit(int(g)) for g in groups]), F.col("g").cast("int")).cast("int") - 1
    anywhere = np.repeat(np.array([points.select("v").first()["v"]], float), len(groups), axis=0)
    every, zero = np.arange(len(groups)), np.zeros(len(groups))
    return points.withColumn("block", number), Pivots(anywhere, groups, every, zero, zero + np.inf, np.full(len(groups), n), metric)


def place(points: DataFrame, metric: Metric = euclidean, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Pivots]:
    """(the points with their ``block``, the table of blocks); points are ``id, g, v`` and perhaps more columns."""
    n = points.count()
    block_rows = max(block_rows, n // BLOCKS)
    if 0 < n <= block_rows:
        return _whole(points, n, metric)
    chosen = _choose(points, n, block_rows)
    pivots, group = _matrix(chosen["v"]) if len(chosen) else np.zeros((0, 1)), chosen["g"].to_numpy(dtype=np.int64)

    def nearest_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            v, g = _matrix(rows["v"]), rows["g"].to_numpy()
            cell, gap = np.zeros(len(rows), np.int64), np.zeros(len(rows))
            for one in np.unique(g):
                own, mine = np.flatnonzero(group == one), g == one
                d = metric(v[mine], pivots[own])
                best = d.argmin(axis=1)
                cell[mine], gap[mine] = own[best], d[np.arange(len(d)), best]
            yield rows.assign(cell=cell, gap=gap)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    near = cut_lineage(points.mapInPandas(nearest_pivot, f"{schema}, cell long, gap double"))
    steps = [i / RINGS for i in range(1, RINGS)]
    edges = near.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("gap", steps, 1000).alias("edges")).where(F.col("n") > 2 * block_rows)
    # a row per crowded cell: there are no more cells than pivots
    crowded = edges.withColumn("every", F.greatest(F.lit(1), F.floor(F.lit(RINGS * block_rows) / F.col("n"))).cast("int"))
    rings = crowded.select("cell", F.filter("edges", lambda x, i: (i + 1) % F.col("every") == 0).alias("edges"))
    ringed = near.join(F.broadcast(rings), "cell", "left").withColumn("ring", F.coalesce(F.size(F.filter("edges", lambda x: x < F.col("gap"))), F.lit(0))).drop("edges")
    # rows at one distance fill a ring of any size, which is then cut by hash
    size = ringed.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).cast("int").alias("parts"))
    parted = ringed.join(F.broadcast(size), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    blocks = parted.groupBy("cell", "ring", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("gap").alias("low"), F.max("gap").alias("high")).toPandas()
    blocks = blocks.sort_values(["cell", "ring", "part"]).reset_index(drop=True)
    numbers = points.sparkSession.createDataFrame([(int(c), int(r), int(p), i) for i, (c, r, p) in enumerate(zip(blocks["cell"], blocks["ring"], blocks["part"]))], "cell long, ring int, part int, block int")
    table = Pivots(pivots, group, *(blocks[c].to_numpy() for c in ("cell", "low", "high", "rows")), metric)
    return cut_lineage(parted.join(F.broadcast(numbers), ["cell", "ring", "part"]).select(*points.columns, "block")), table


def _wide(n: int, block_rows: int = BLOCK_ROWS) -> int:
    """Rows of a side of a task where most rows meet most rows, so that a row travels some 32 times in tables of up to a million rows."""
    return max(block_rows, min(WIDE_ROWS, n // 32))


def _meet(visits: DataFrame, points: DataFrame, kernel: Callable, schema: str, report: dict | None, visitors: int = VISITORS) -> DataFrame:
    """Bring every visit to the points of its ``block``; blocks with many visitors are met in several tasks."""
    visits = cut_lineage(visits)
    load = cut_lineage(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / visitors).cast("int").alias("tasks"), F.count(F.lit(1)).alias("visitors")))
    if report is not None:
        rows = points.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
        report["pairs"] = report.get("pairs", 0) + (load.join(rows, "block").agg(F.sum(F.col("visitors") * F.col("rows"))).first()[0] or 0)
        report["rounds"] = report.get("rounds", 0) + 1
    tasks = load.select("block", "tasks")  # one row per block
    left = visits.join(F.broadcast(tasks), "block").withColumn("task", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).drop("tasks")
    right = points.join(F.broadcast(tasks), "block").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    right = right.select(*[F.col(c).alias(f"p_{c}") for c in right.columns])
    return left.groupBy("block", "task").cogroup(right.groupBy("p_block", "p_task")).applyInPandas(kernel, schema)


def _in_plane(points: DataFrame) -> int:
    """Number of rows if all have the same one or two finite numbers, else 0."""
    finite = F.forall("v", lambda x: F.abs(x) < float("inf"))
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.bool_and(finite).alias("finite")).first()
    return facts["n"] if facts["finite"] and facts["least"] == facts["most"] in (1, 2) else 0


def search(queries: DataFrame, points: DataFrame, k: int, metric: Metric = euclidean, block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """``id, best``: the k nearest points as sorted (distance, neighbour), ties to the smaller id.

    Both inputs are ``id`` (unique integer), ``g`` (a group: queries meet points of their own only) and ``v``.
    Many points in the plane, by the larger gap, are searched by :func:`plane.search`, which visits next to no blocks.
    """
    if metric is chebyshev and report is None and _in_plane(points) > PLANE_ROWS and _in_plane(queries):
        return plane.search(queries, points, k)
    placed, table = place(points.select("id", "g", "v"), metric, block_rows)

    def in_reach(rows: pd.DataFrame, begin: int, end: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, int]]:
        """(rows, number of the row and block of every visit, blocks that are left) for some rows at a time."""
        for g, same in rows.groupby("g"):
            for at in range(0, len(same), 256):
                part = same.iloc[at : at + 256]
                own, low, high = table.bounds(int(g), _matrix(part["v"]))
                if begin >= len(own):
                    continue
                # the k-th distance is at most the largest one to blocks that hold k points; a block has one at least
                order = _least(high, k)
                enough = np.minimum((np.cumsum(table.rows[own][order], axis=1) < k).sum(axis=1), order.shape[1] - 1)
                reach = np.take_along_axis(high, order, 1)[np.arange(len(part)), enough]
                if table.rows[own].sum() < k:
                    reach[:] = np.inf
                reach = np.minimum(reach, part["kth"].to_numpy())
                first = _least(low, end)[:, begin:]
                wanted = np.take_along_axis(low, first, 1) <= reach[:, None]
                q, b = np.nonzero(wanted)
                yield part, q, own[first[q, b]], wanted.size

    def next_blocks(begin: int, end: int, number: np.ndarray | None = None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for part, q, block, _ in in_reach(rows, begin, end):
                    if number is not None:
                        q, block = np.unique(np.stack([q, number[block]]), axis=1)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[q], "v": part["v"].to_numpy()[q], "kth": part["kth"].to_numpy()[q], "block": block})

        return run

    def reached(begin: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for _, q, _, left in in_reach(rows, begin, len(table.cell)):
                    yield pd.DataFrame({"wanted": [len(q)], "left": [left]})

        return run

    def kernel(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        p = p.sort_values("p_id", kind="stable")
        ids, asked, own, points = p["p_id"].to_numpy(), q["id"].to_numpy(), _matrix(q["v"]), _matrix(p["p_v"])
        kth, step, out = q["kth"].to_numpy(), max(1, CELLS // len(p)), []
        for at in range(0, len(own), step):
            limit = kth[at : at + step]
            product = metric is euclidean and points.shape[1] > FEW_DIMENSIONS and not np.isnan(limit).any()
            near = _may_be_near(own[at : at + step], points, limit, k) if product else None
            if near is not None:
                row, column = near
                exact = _listed_distances(own[at : at + step], points, row, column)
            else:
                d = metric(own[at : at + step], points)
                open_rows = np.isinf(limit)
                if open_rows.any() and k < d.shape[1]:
                    limit = np.where(open_rows, np.partition(d, k - 1, axis=1)[:, k - 1], limit)
                # a product of matrices is right but for rounding, so what may be among the k nearest is measured again
                row, column = np.nonzero((d <= (limit * (1 + 4 * SLACK))[:, None]) | np.isnan(limit)[:, None])
                exact = _listed_distances(own[at : at + step], points, row, column) if metric is euclidean else d[row, column]
            order = np.lexsort((column, exact, row))
            row, column, exact = row[order], column[order], exact[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((asked[at + row[keep]], ids[column[keep]], exact[keep]))
        columns = [np.concatenate(c) for c in zip(*out)]
        return pd.DataFrame(dict(zip(("id", "neighbour", "distance"), columns)))

    entry = F.struct("distance", "neighbour")
    state = queries.select("id", "g", "v", F.array().cast("array<struct<distance:double,neighbour:bigint>>").alias("best"))
    known = F.col("best")["neighbour"]
    begin, wave = 0, 1
    while begin < len(table.cell):
        kth = F.when(F.size("best") >= k, F.element_at("best", k)["distance"]).otherwise(float("inf"))
        asking = state.select("id", "g", "v", kth.alias("kth"))
        dense = False
        if begin == MANY_VISITED and len(table.cell) > 4 * MANY_VISITED:
            ahead = asking.mapInPandas(reached(begin), "wanted long, left long").agg(F.sum("wanted"), F.sum("left")).first()
            dense = 2 * (ahead[0] or 0) > (ahead[1] or 0)
        if dense:
            # bounds spare little, so a query meets all that is left at once, in blocks so large that it travels seldom
            rows = _wide(int(table.rows.sum()), block_rows)
            number = table.merged(rows)
            visits = asking.mapInPandas(next_blocks(begin, len(table.cell), number), "id long, v array<double>, kth double, block int")
            found = _meet(visits, _in_wide_blocks(placed, number), kernel, "id long, neighbour long, distance double", report, rows)
            wave = len(table.cell)
        else:
            visits = asking.mapInPandas(next_blocks(begin, begin + wave), "id long, v array<double>, kth double, block int")
            found = _meet(visits, placed, kernel, "id long, neighbour long, distance double", report)
        fresh = found.groupBy("id").agg(F.collect_list(entry).alias("fresh"))
        more = F.filter(F.coalesce("fresh", F.array()), lambda x: ~F.array_contains(known, x["neighbour"]))
        merged = state.join(fresh, "id", "left").withColumn("best", F.slice(F.array_sort(F.concat("best", more)), 1, k))
        begin, wave = begin + wave, 4 * wave
        if begin >= len(table.cell):
            return merged.select("id", "best")
        state = cut_lineage(merged.withColumn("moved", F.col("fresh").isNotNull()).drop("fresh"))
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("id", "best")


def _grouped(rows: DataFrame) -> DataFrame:
    g = F.col("g").cast("int") if "g" in rows.columns else F.lit(0)
    return rows.where(F.col("v").isNotNull()).select("id", g.alias("g"), "v")


def nearest(queries: DataFrame, points: DataFrame, k: int, exclude_self: bool = False, block_rows: int = BLOCK_ROWS, metric: Metric = euclidean, report: dict | None = None) -> DataFrame:
    """``id, neighbour, distance, rank`` of the k nearest points; ties go to the smaller id.

    Both inputs are ``id`` (unique integer), ``v`` (array<double>) and perhaps ``g``, an integer: rows meet rows
    of their own group only.
    """
    alone = queries is points
    points = cut_lineage(_grouped(points))
    kept = cut_lineage(points.groupBy("g", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    queries = points if alone else cut_lineage(_grouped(queries))
    asked = kept.drop("n") if alone else cut_lineage(queries.groupBy("g", "v").agg(F.min("id").alias("id")))
    wide = k + 1 if exclude_self else k
    lists, copied = search(asked, kept, wide, metric, block_rows, report), not kept.where("n > 1").isEmpty()
    if alone and not copied and metric is chebyshev:
        # every row stands for itself
        return _ranked(lists, k, exclude_self)
    found = lists.select(F.col("id").alias("first"), F.posexplode("best").alias("at", "b")).select("first", "b.distance", F.col("b.neighbour").alias("copy"))
    if copied:
        # the smallest ids among equal vectors, first within parts so that no vector is sorted whole
        copies = points.join(kept.where("n > 1").select("g", "v", F.col("id").alias("copy"), "n"), ["g", "v"])
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 10_000))
        for keys in (["copy", "part"], ["copy"]):
            copies = copies.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= wide)
        members = copies.groupBy("copy").agg(F.collect_list("id").alias("ids"))  # at most k + 1 a vector
        found = found.join(members, "copy", "left").select("first", "distance", F.explode(F.coalesce("ids", F.array("copy"))).alias("neighbour"))
    else:
        found = found.withColumnRenamed("copy", "neighbour")
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, wide)
    lists = found.groupBy("first").agg(best.alias("best"))
    names = queries.join(asked.select("g", "v", F.col("id").alias("first")), ["g", "v"]).select("id", "first")
    return _ranked(names.join(lists, "first"), k, exclude_self)


def _ranked(lists: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    out = lists.select("id", F.filter("best", lambda b: b["neighbour"] != F.col("id")).alias("best") if exclude_self else "best")
    return out.select("id", F.posexplode(F.slice("best", 1, k)).alias("at", "b")).select("id", "b.neighbour", "b.distance", (F.col("at") + 1).alias("rank"))


def _sums_kernel(transform: Callable[[np.ndarray], np.ndarray], exclude_self: bool) -> Callable:
    def kernel(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"id": [], "label": [], "total": [], "n": []})
        labels, code = np.unique(p["p_label"].to_numpy(), return_inverse=True)
        copies = p["p_n"].to_numpy(dtype=float)
        member = np.zeros((len(p), len(labels)))
        member[np.arange(len(p)), code] = copies
        own, points, step = _matrix(q["v"]), _matrix(p["p_v"]), max(1, CELLS // len(p))
        total, n = np.empty((len(q), len(labels))), np.tile(member.sum(axis=0), (len(q), 1))
        for at in range(0, len(q), step):
            d = euclidean(own[at : at + step], points)
            row, column = np.nonzero(d == 0) if exclude_self else (np.zeros(0, int), np.zeros(0, int))
            weight = transform(d)
            if len(row):
                mine = q["own"].to_numpy()[at + row] == p["p_label"].to_numpy()[column]
                row, column = row[mine], column[mine]
                np.subtract.at(n, (at + row, code[column]), 1.0)
                weight[row, column] *= (copies[column] - 1) / copies[column]
            total[at : at + step] = weight @ member
        return pd.DataFrame({"id": np.repeat(q["id"].to_numpy(), len(labels)), "label": np.tile(labels, len(q)), "total": total.ravel(), "n": n.ravel().astype("int64")})

    return kernel


def _copies_merged(queries: DataFrame, points: DataFrame, exclude_self: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(different queries, different points with their number, id of every query with the id that stands for it)."""
    queries = queries.where(F.col("v").isNotNull())
    if exclude_self:
        queries = queries.select("id", "v").join(points.select("id", F.col("label").alias("own")), "id")
        keys = ["v", "own"]
    else:
        queries, keys = queries.select("id", "v"), ["v"]
    queries = cut_lineage(queries)
    asked = cut_lineage(queries.groupBy(*keys).agg(F.min("id").alias("id")))
    same = [queries[c].eqNullSafe(asked[c]) for c in keys]
    on = same[0] if len(same) == 1 else same[0] & same[1]
    names = queries.join(asked, on).select(queries["id"], asked["id"].alias("first"))
    kept = points.where(F.col("v").isNotNull()).groupBy("v", "label").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return asked, cut_lineage(kept), names


def class_sums(queries: DataFrame, points: DataFrame, transform: Callable[[np.ndarray], np.ndarray], exclude_self: bool = False, block_rows: int = BLOCK_ROWS, beyond: float | None = None, report: dict | None = None) -> DataFrame:
    """``id, label, total, n``: sum of ``transform(distance)`` to the points of every label; ``transform`` may write into its argument.

    With ``beyond`` a query leaves out the blocks that lie farther than its nearest pivots by that much; ``n``
    then counts the points that it met.
    """
    asked, kept, names = _copies_merged(queries, points, exclude_self)
    placed, table = place(kept.withColumn("g", F.lit(0)), euclidean, block_rows)

    def reached(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the row and block of every visit, pairs of a row and a block)."""
        own, low, _ = table.bounds(0, _matrix(part["v"]))
        if beyond is not None and len(own):
            d = np.sort(euclidean(_matrix(part["v"]), table.points), axis=1)
            # the nearest pivot may be the row itself, so the second one counts where there is one
            reach = d[:, min(1, d.shape[1] - 1)] + beyond if d.shape[1] > 1 else np.full(len(part), np.inf)
            q, b = np.nonzero(low <= reach[:, None])
        else:
            q, b = np.nonzero(np.ones((len(part), len(own)), bool))
        return q, own[b], low.size

    def blocks(number: np.ndarray | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for at in range(0, len(rows), 256):
                    part = rows.iloc[at : at + 256]
                    q, block, _ = reached(part)
                    if number is not None:
                        q, block = np.unique(np.stack([q, number[block]]), axis=1)
                    yield part.iloc[q].assign(block=block)

        return run

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 256):
                q, _, every = reached(rows.iloc[at : at + 256])
                yield pd.DataFrame({"wanted": [len(q)], "every": [every]})

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    kind = points.schema["label"].dataType.simpleString()
    number, visitors = None, VISITORS
    if len(table.cell) > 4 * MANY_VISITED:
        met = asked.mapInPandas(counted, "wanted long, every long").agg(F.sum("wanted"), F.sum("every")).first()
        if 2 * (met[0] or 0) > (met[1] or 0):
            # bounds spare little, so rows travel to blocks so large that they travel seldom
            visitors = _wide(int(table.rows.sum()), block_rows)
            number = table.merged(visitors)
            placed = _in_wide_blocks(placed, number)
    met = _meet(asked.mapInPandas(blocks(number), f"{types}, block int"), placed, _sums_kernel(transform, exclude_self), f"id long, label {kind}, total double, n long", report, visitors)
    sums = met.groupBy(F.col("id").alias("first"), "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return names.join(sums, "first").select("id", "label", "total", "n")


def kernel_vote(queries: DataFrame, points: DataFrame, width: float = 1.0, exclude_self: bool = False, block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """``id, label, p``: class scores sum(exp(-distance / width)), normalised.

    Points so far that all of them together weigh less than the last bit of the nearest pivot are not visited;
    a class without a visited point scores 0.
    """
    rows = max(points.count(), 1)
    beyond = width * (math.log(rows) + 37.0)
    sums = class_sums(queries, points, lambda d: np.exp(np.divide(d, -width, out=d), out=d), exclude_self, block_rows, beyond, report)
    # every class stands in the result, so the list of classes is as long as the rows of one query
    kind = points.schema["label"].dataType
    names = [r["label"] for r in points.where(F.col("v").isNotNull() & F.col("label").isNotNull()).select("label").distinct().collect()]
    found = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "total"))).alias("totals"), F.sum("total").alias("whole"))
    cells = F.transform(F.array(*[F.lit(x).cast(kind) for x in names]), lambda x: F.struct(x.alias("label"), F.coalesce(F.try_element_at("totals", x), F.lit(0.0)).alias("total")))
    return found.select("id", "whole", F.inline(cells)).select("id", "label", ((F.col("total") + 0.0) / (F.col("whole") + 1e-12)).alias("p"))


def knn_vote(queries: DataFrame, points: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
    """``id, prediction``: most frequent label among the k nearest points, the smallest on a tie."""
    near = nearest(queries, points, k, exclude_self)
    labels = points.select(F.col("id").alias("neighbour"), "label")
    votes = near.join(labels, "neighbour").groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("k"), "label"))["label"].alias("prediction"))


def knn_mean(queries: DataFrame, points: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
    """``id, prediction``: mean target ``y`` of the k nearest points."""
    near = nearest(queries, points, k, exclude_self)
    return near.join(points.select(F.col("id").alias("neighbour"), "y"), "neighbour").groupBy("id").agg(F.avg("y").alias("prediction"))


def _label_table(points: DataFrame) -> pd.DataFrame | None:
    """Rows, mean and mean squared norm of every label; None if that is too much for a task to keep."""
    size = points.select(F.size("v").alias("d")).agg(F.max("d")).first()[0] or 0
    if points.select("label").distinct().count() * (size + 2) > LABEL_NUMBERS:
        return None
    sums = points.select("label", "n", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x") * F.col("n")).alias("s"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("q"), F.sum("n").alias("n"))
    flat = sums.orderBy("label", "i").toPandas()
    rows = [(label, own["n"].iloc[0], (own["s"] / own["n"]).to_numpy(), float((own["q"] / own["n"]).sum())) for label, own in flat.groupby("label", sort=True)]
    return pd.DataFrame(rows, columns=["label", "n", "mean", "square"])


def silhouette(points: DataFrame, block_rows: int = BLOCK_ROWS, report: dict | None = None) -> DataFrame:
    """Exact Euclidean silhouette per row of ``id, v, label``; rows of one-row clusters score 0.

    The mean distance to a cluster lies between the distance to its centre and the root of that squared plus the
    cluster's variance, so a row visits its own cluster and those that may be the nearest one.
    """
    points = points.where(F.col("v").isNotNull() & F.col("label").isNotNull()).select("id", "v", "label")
    asked, kept, names = _copies_merged(points, points, True)
    # a row meets a cluster whole or not at all, so parts of a cluster may be large
    block_rows = _wide(kept.count(), block_rows)
    parts = kept.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    dealt = cut_lineage(kept.join(parts, "label").withColumn("block", F.struct("label", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))).drop("parts"))
    parts = cut_lineage(parts)
    table = _label_table(kept)
    kind = points.schema["label"].dataType.simpleString()
    if table is None:
        visits = asked.crossJoin(parts.select("label"))  # no bound is at hand, so every row meets every cluster
    else:
        means, square, n = np.stack(table["mean"]) if len(table) else np.zeros((0, 1)), table["square"].to_numpy(dtype=float), table["label"].to_numpy()
        spread = np.maximum(square - (means * means).sum(axis=1), 0.0)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if rows.empty:
                    continue
                own = rows["own"].to_numpy()[:, None] == n[None, :]
                low = euclidean(_matrix(rows["v"]), means)
                room = SLACK * (low * low + square + spread)
                high = np.where(own, np.inf, np.sqrt(low * low + spread + room))
                q, b = np.nonzero(own | (low <= high.min(axis=1, initial=np.inf)[:, None] + np.sqrt(room)))
                yield rows.iloc[q].assign(label=n[b])

        visits = asked.mapInPandas(near, f"v array<double>, own {kind}, id long, label {kind}")
    visits = visits.join(parts, "label").select("id", "v", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct("label", x.alias("part")))).alias("block"))
    met = _meet(visits, dealt, _sums_kernel(lambda d: d, True), f"id long, label {kind}, total double, n long", report, max(VISITORS, block_rows))
    sums = met.groupBy("id", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean, mine = F.try_divide(F.col("total"), F.col("n")), F.col("label") == F.col("own")
    ab = sums.join(asked.select("id", "own"), "id").groupBy("id").agg(F.max("own").alias("label"), F.max(F.when(mine, mean)).alias("a"), F.min(F.when(~mine, mean)).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return names.join(ab.select(F.col("id").alias("first"), "label", score.alias("silhouette")), "first").select("id", "label", "silhouette")


def _tile_sums(starts: Sequence[int]) -> Callable:
    """Sums of distances to every cluster of every labelling, for the rows of both sides of a tile."""
    width = starts[-1]

    def member(rows: pd.DataFrame) -> np.ndarray:
        out, n = np.zeros((len(rows), width)), rows["n"].to_numpy(dtype=float)
        labels = np.array(rows["labels"].tolist(), np.int64).reshape(len(rows), len(starts) - 1)
        for i, start in enumerate(starts[:-1]):
            out[np.arange(len(rows)), start + labels[:, i]] = n
        return out

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        sides = [rows[rows["chunk"] == i]] if i == j else [rows[rows["chunk"] == i], rows[rows["chunk"] == j]]
        own, other = sides[0], sides[-1]
        q, p = _matrix(own["v"]), _matrix(other["v"])
        if not len(q) or not len(p):
            return pd.DataFrame({"id": [], **{f"s{c}": [] for c in range(width)}})
        theirs, mine = member(other), member(own)
        there, back, step = np.empty((len(q), width)), np.zeros((len(p), width)), max(1, CELLS // len(p))
        for at in range(0, len(q), step):
            d = euclidean(q[at : at + step], p)
            there[at : at + step] = d @ theirs
            if i != j:
                back += d.T @ mine[at : at + step]
        ids, sums = [own["id"].to_numpy()], [there]
        if i != j:
            ids, sums = [*ids, other["id"].to_numpy()], [*sums, back]
        return pd.DataFrame(np.concatenate(sums), columns=[f"s{c}" for c in range(width)]).assign(id=np.concatenate(ids))

    return kernel


def mean_silhouettes(points: DataFrame, sizes: Sequence[int], chunk_rows: int | None = None) -> list[float]:
    """Exact mean silhouette of every labelling of ``id, v, labels``; labelling i has the labels 0 to ``sizes[i] - 1``.

    Equal vectors have equal labels.  All labellings share their distances: the rows are cut into chunks, and
    every pair of chunks is a tile, whose distances serve the rows of both.  Rows of one-row clusters score 0.  In
    the mean a row counts once for every row of its id, as in the join of :func:`silhouette`.  Many rows of one or
    two numbers are not compared in pairs: :func:`plane.mean_silhouettes`.
    """
    starts = [0, *np.cumsum(list(sizes)).tolist()]
    width = starts[-1]
    weighed = points.withColumn("weight", F.count(F.lit(1)).over(Window.partitionBy("id")))
    kept = cut_lineage(weighed.groupBy("v").agg(F.min("id").alias("id"), F.min("labels").alias("labels"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")))
    n = kept.count()
    if chunk_rows is None and n > PLANE_ROWS and _in_plane(kept):
        return plane.mean_silhouettes(kept, starts)
    chunks = max(1, math.ceil(n / (chunk_rows or _wide(n))))
    dealt = kept.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("other")
    sides = dealt.select("id", "v", "labels", "n", "chunk", other).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other")
    tiles = sides.repartition(chunks * (chunks + 1) // 2, "i", "j")
    met = tiles.groupBy("i", "j").applyInPandas(_tile_sums(starts), ", ".join(["id long", *[f"s{c} double" for c in range(width)]]))
    sums = met.groupBy("id").agg(F.array(*[F.sum(f"s{c}") for c in range(width)]).alias("sums"))
    rows = cut_lineage(kept.select("id", "labels", "n", "weight").join(sums, "id"))
    counts = rows.agg(*[F.sum(F.when(F.col("labels")[i] == c, F.col("n"))).alias(f"n{start + c}") for i, start in enumerate(starts[:-1]) for c in range(sizes[i])]).first()
    count = [float(counts[f"n{c}"] or 0) for c in range(width)]
    scores = []
    for i, start in enumerate(starts[:-1]):
        mine, cells = F.col("labels")[i], range(start, starts[i + 1])
        # sums and sizes of the own cluster without the row, and the nearest of the other clusters that have rows
        a = F.coalesce(*[F.when(mine == c - start, F.try_divide(F.col("sums")[c], F.lit(count[c] - 1))) for c in cells])
        means = [F.when(mine != c - start, F.col("sums")[c] / F.lit(count[c])) for c in cells if count[c]]
        b = F.array_min(F.array(*means))
        score = F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
        scores.append(F.sum(score * F.col("weight")) / F.sum("weight"))
    found = rows.agg(*[s.alias(f"m{i}") for i, s in enumerate(scores)]).first()
    return [float(found[f"m{i}"] or 0.0) for i in range(len(sizes))]


def smote(df: DataFrame, features: Sequence[str], label: str, minority: object, per_row: int = 1, k: int = 5, seed: int = 42, key: str = "id") -> DataFrame:
    """Synthetic minority rows between a row and one of its k nearest minority neighbours."""
    small = df.where(F.col(quoted(label)) == F.lit(minority)).select(F.col(quoted(key)).alias("id"), vector(df, features).alias("v"))
    near = nearest(small, small, k, exclude_self=True)
    made = small.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("copy"))
    reach = near.groupBy(F.col("id")).agg(F.count(F.lit(1)).alias("found"))
    made = made.join(reach, "id").withColumn("rank", (F.pmod(F.xxhash64(F.lit(seed), "id", "copy"), F.col("found")) + 1).cast("int"))
    other = small.select(F.col("id").alias("neighbour"), F.transform("v", lambda x: x).alias("w"))
    u = F.xxhash64(F.lit(seed + 1), "id", "copy").cast("double") / 2.0**64 + 0.5
    mixed = made.join(near.select("id", "rank", "neighbour"), ["id", "rank"]).join(other, "neighbour").withColumn("u", u)
    return mixed.select(
        *[(F.col("v")[i] + F.col("u") * (F.col("w")[i] - F.col("v")[i])).alias(f) for i, f in enumerate(features)], F.lit(minority).alias(label)
    )
