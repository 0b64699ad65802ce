"""Density clustering on a grid, without listing the pairs inside crowded cells.

With cells of side eps / sqrt(d) all rows of a cell are neighbours of each other.  A cell with
``min_samples`` rows therefore makes all its rows core rows and puts them in one cluster, whatever their
number; only rows of thinner cells are compared with the rows around them.  Clusters are connected
components of cells, linked when two core rows in neighbouring cells lie within eps.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.core.ordering import ordered_index
from plumbrule.core.session import cut_lineage

SALT_ROWS = 20_000
SUB = 16


def _cells(features: Sequence[str], side: float) -> list[Column]:
    return [F.floor(F.col(quoted(c)).cast("double") / side).cast("long") for c in features]


def _offsets(d: int) -> list[tuple[int, ...]]:
    reach = math.ceil(math.sqrt(d))
    every = itertools.product(range(-reach, reach + 1), repeat=d)
    # two cells can hold rows within eps only if the gap between them is at most sqrt(d) sides
    return [o for o in every if any(o) and sum(max(abs(x) - 1, 0) ** 2 for x in o) <= d]


def _gap(a: str, b: str, d: int) -> Column:
    out = F.lit(0.0)
    for i in range(d):
        out = out + (F.col(f"{a}{i}") - F.col(f"{b}{i}")) * (F.col(f"{a}{i}") - F.col(f"{b}{i}"))
    return F.sqrt(out)


def _around(df: DataFrame, d: int, offsets: Sequence[tuple[int, ...]], prefix: str) -> DataFrame:
    """Repeat each row for every neighbouring cell, named ``<prefix>0..``."""
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"m{i}") for i, x in enumerate(o)]) for o in offsets])
    out = df.select("*", F.explode(moves).alias("_m"))
    return out.withColumns({f"{prefix}{i}": F.col(f"c{i}") + F.col(f"_m.m{i}") for i in range(d)}).drop("_m")


def prepare(df: DataFrame, key: str, features: Sequence[str], eps: float) -> DataFrame:
    """``id, x0.., c0..``: key, coordinates and grid cell."""
    d = len(features)
    if not 1 <= d <= 4:
        raise ValueError("grid clustering takes one to four columns; project the data first")
    side = eps / math.sqrt(d)
    return df.select(
        F.col(quoted(key)).cast("long").alias("id"),
        *[F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        *[c.alias(f"c{i}") for i, c in enumerate(_cells(features, side))],
    )


def _sparse_pairs(points: DataFrame, sparse: DataFrame, sizes: DataFrame, d: int, eps: float) -> DataFrame:
    """``id, other``: rows of other cells within eps of each sparse row.

    A sparse cell has fewer than ``min_samples`` rows, so a crowded neighbour cell is read that often at
    most; its rows are dealt over salts so that no task holds the cell.
    """
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    near = _around(sparse.select("id", *[f"x{i}" for i in range(d)], *[f"c{i}" for i in range(d)]), d, _offsets(d), "k")
    cells = sizes.select(*[F.col(f"c{i}").alias(f"k{i}") for i in range(d)], salts.alias("salts"))
    asked = near.join(cells, [f"k{i}" for i in range(d)]).select(
        "id", *[F.col(f"x{i}").alias(f"q{i}") for i in range(d)], *[f"k{i}" for i in range(d)], F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    others = points.join(sizes.select(*[f"c{i}" for i in range(d)], salts.alias("salts")), [f"c{i}" for i in range(d)]).select(
        F.col("id").alias("other"),
        *[f"x{i}" for i in range(d)],
        *[F.col(f"c{i}").alias(f"k{i}") for i in range(d)],
        F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"),
    )
    return asked.join(others, [*[f"k{i}" for i in range(d)], "salt"]).where(_gap("q", "x", d) <= eps).select("id", "other")


def core_points(points: DataFrame, d: int, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """(all rows with ``core``, pairs of sparse rows): a row counts itself as a neighbour."""
    cols = [f"c{i}" for i in range(d)]
    sizes = points.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    sized = points.join(sizes, cols)
    sparse = sized.where(F.col("n") < min_samples)
    pairs = _sparse_pairs(points, sparse, sizes, d, eps)
    outside = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("outside"))
    marked = sized.join(outside, "id", "left").withColumn("neighbours_seen", F.col("n") + F.coalesce("outside", F.lit(0)))
    return marked.withColumn("core", F.col("neighbours_seen") >= min_samples).drop("n", "outside", "neighbours_seen"), pairs


def eps_core_points(df: DataFrame, key: str, features: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """``id, core`` of every row."""
    return core_points(prepare(df, key, features, eps), len(features), eps, min_samples)[0].select("id", "core")


def _cell_links(core: DataFrame, d: int, eps: float) -> DataFrame:
    """``a, b``: node ids of neighbouring cells with two core rows within eps.

    Cells are first compared through the bounding boxes of their sub-cells: boxes wholly within eps link the
    cells, boxes wholly apart do not, and only the boxes in between are compared row by row, on distinct
    coordinates and only for cell pairs not linked already.
    """
    cols, half = [f"c{i}" for i in range(d)], [o for o in _offsets(d) if o > tuple([0] * d)]
    side = eps / math.sqrt(d)
    nodes = core.groupBy(*cols).agg(F.min("id").alias("node"))
    spot = [F.least(F.floor((F.col(f"x{i}") / side - F.col(f"c{i}")) * SUB), F.lit(SUB - 1)).cast("int").alias(f"s{i}") for i in range(d)]
    fine = core.join(nodes, cols).select("node", *cols, *[f"x{i}" for i in range(d)], *spot).dropDuplicates(["node", *[f"x{i}" for i in range(d)]])
    subs = [f"s{i}" for i in range(d)]
    boxes = fine.groupBy("node", *cols, *subs).agg(
        *[F.min(f"x{i}").alias(f"lo{i}") for i in range(d)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(d)]
    )
    left = _around(boxes, d, half, "k").select(
        F.col("node").alias("a"), *[F.col(s).alias(f"a_{s}") for s in subs], *[f"k{i}" for i in range(d)],
        *[F.col(f"lo{i}").alias(f"alo{i}") for i in range(d)], *[F.col(f"hi{i}").alias(f"ahi{i}") for i in range(d)],
    )
    right = boxes.select(F.col("node").alias("b"), *[F.col(s).alias(f"b_{s}") for s in subs], *[F.col(f"c{i}").alias(f"k{i}") for i in range(d)],
                         *[f"lo{i}" for i in range(d)], *[f"hi{i}" for i in range(d)])
    least, most = F.lit(0.0), F.lit(0.0)
    for i in range(d):
        apart = F.greatest(F.col(f"lo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"hi{i}"), F.lit(0.0))
        span = F.greatest(F.col(f"hi{i}") - F.col(f"alo{i}"), F.col(f"ahi{i}") - F.col(f"lo{i}"))
        least, most = least + apart * apart, most + span * span
    met = left.join(right, [f"k{i}" for i in range(d)]).withColumns({"least": F.sqrt(least), "most": F.sqrt(most)}).where(F.col("least") <= eps)
    sure = met.groupBy("a", "b").agg(F.min("most").alias("most"))
    linked = sure.where(F.col("most") <= eps).select("a", "b")
    open_boxes = met.join(sure.where(F.col("most") > eps).select("a", "b"), ["a", "b"]).select("a", "b", *[f"a_{s}" for s in subs], *[f"b_{s}" for s in subs])
    rows_a = fine.select(F.col("node").alias("a"), *[F.col(s).alias(f"a_{s}") for s in subs], *[F.col(f"x{i}").alias(f"q{i}") for i in range(d)])
    rows_b = fine.select(F.col("node").alias("b"), *[F.col(s).alias(f"b_{s}") for s in subs], *[f"x{i}" for i in range(d)])
    close = (
        open_boxes.join(rows_a, ["a", *[f"a_{s}" for s in subs]])
        .join(rows_b, ["b", *[f"b_{s}" for s in subs]])
        .where(_gap("q", "x", d) <= eps)
        .select("a", "b")
        .distinct()
    )
    return linked.unionByName(close)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label``: smallest node id of each connected component.

    Each round points every node at its smallest neighbour, follows these pointers to their roots by
    doubling, and goes on with the graph of the roots, which has at most half as many nodes with links.
    """
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select("node", F.col("node").alias("label"))
    while not edges.isEmpty():
        roots = _roots(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).select(F.col("a").alias("from"), "to"))
        labels = cut_lineage(labels.join(roots, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label")))
        ends = edges.join(roots.select(F.col("from").alias("a"), F.col("to").alias("ra")), "a").join(roots.select(F.col("from").alias("b"), F.col("to").alias("rb")), "b")
        edges = cut_lineage(ends.where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return labels


def _roots(pointers: DataFrame) -> DataFrame:
    """Follow ``from -> to`` (never upwards) to the end by repeated doubling."""
    pointers = cut_lineage(pointers)
    while True:
        ahead = pointers.select(F.col("from").alias("to"), F.col("to").alias("next"))
        # written before it is asked: the test and the next round read the join, they do not repeat it
        doubled = cut_lineage(pointers.join(ahead, "to", "left").select("from", "to", F.coalesce("next", "to").alias("next")))
        if doubled.where("next != to").isEmpty():
            return pointers
        pointers = doubled.select("from", F.col("next").alias("to"))


def dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """``id, core, cluster``: clusters are numbered by their smallest core key, noise is -1.

    A border row joins the lowest-numbered cluster among its core neighbours.
    """
    d = len(features)
    cols = [f"c{i}" for i in range(d)]
    marked, pairs = core_points(prepare(df, key, features, eps), d, eps, min_samples)
    marked = cut_lineage(marked)
    core = marked.where("core")
    nodes = core.groupBy(*cols).agg(F.min("id").alias("node"))
    labels = components(nodes, _cell_links(core, d, eps))
    numbers = ordered_index(labels.select("label").distinct(), ["label"], name="cluster")
    cells = nodes.join(labels, "node").join(numbers, "label").select(*cols, "cluster")
    own = core.join(cells, cols).select("id", "cluster")
    # a border row shares no cell with min_samples rows, so its core neighbours are in its own cell or in the pairs
    border = marked.where(~F.col("core"))
    inside = border.join(cells, cols).select("id", "cluster")
    across = border.select("id").join(pairs, "id").join(own.select(F.col("id").alias("other"), "cluster"), "other").select("id", "cluster")
    reached = inside.unionByName(across).groupBy("id").agg(F.min("cluster").alias("cluster"))
    known = own.unionByName(reached)
    return marked.select("id", "core").join(known, "id", "left").select("id", "core", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def eps_sweep(df: DataFrame, key: str, features: Sequence[str], eps_values: Sequence[float], min_samples: int, truth: str | None = None) -> DataFrame:
    """Clusters and noise share per eps, and the adjusted Rand index against ``truth`` when given."""
    from plumbrule.operators.clusters import external_quality

    out = None
    for eps in eps_values:
        found = cut_lineage(dbscan(df, key, features, eps, min_samples))
        row = found.agg(
            F.lit(float(eps)).alias("eps"), (F.max("cluster") + 1).alias("clusters"), F.avg((F.col("cluster") == -1).cast("double")).alias("noise_share")
        )
        if truth is not None:
            known = found.join(df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(truth)).alias("truth")), "id")
            row = row.withColumn("ari", external_quality(known, "truth", "cluster").select("ari").scalar())
        out = row if out is None else out.unionByName(row)
    return out
