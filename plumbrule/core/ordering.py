"""Global order without a global sort task.

A window without (or with a very large) partition key runs in one task.  The operators here cut the
order key into ranges, number or sum the rows inside every range, and add the total of the earlier
ranges.  Cut points are plain literals taken from an approximate-quantile sketch, so a lost executor
recomputes the same ranges; the results are exact whatever the cut points are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrule.core.frames import as_double, field_types, is_numeric, quoted
from plumbrule.core.session import cut_lineage

RANGE, PART, GROUP = "_range", "_part", "_group"
BRACKET_ROWS = 4_000_000


def order_number(name: str, dtype: T.DataType) -> Column:
    """A double that never decreases when the column increases; used for choosing ranges only."""
    c = F.col(quoted(name))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if is_numeric(dtype):
        return c.cast("double")
    raise TypeError(f"order key {name} must be a number, date or timestamp")


def _has_number(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def range_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Tasks among which the sketches of all map tasks are merged before the last one.
LEAVES = 64


def cut_points(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles of every column in one pass; at most ``parts`` numbers per column."""
    types = field_types(df)
    parts = parts or range_count(df)
    base = df.select(*[order_number(c, types[c]).alias(f"x{i}") for i, c in enumerate(columns)])
    row = _grid_quantiles(base, len(columns), range(1, parts), parts)
    return {c: sorted({float(v) for v in (row[f"g{i}"] or []) if v == v}) for i, c in enumerate(columns)}


def _grid_quantiles(base: DataFrame, width: int, steps: range, grid: int):
    """One row: ``rows``, and for each column ``x0..`` its value count ``n`` and quantiles ``g`` at ``steps / grid``.

    Every map task makes one sketch per column; these meet in ``LEAVES`` tasks, whose results meet in one.  The
    size of a sketch depends on the grid only.
    """
    size = F.lit(min(65_535, max(200, 8 * grid)))
    leaf = F.pmod(F.spark_partition_id(), F.lit(LEAVES))
    sums = [x for i in range(width) for x in (F.count(f"x{i}").alias(f"n{i}"), F.kll_sketch_agg_double(f"x{i}", size).alias(f"s{i}"))]
    leaves = base.withColumn("_leaf", leaf).groupBy("_leaf").agg(F.count(F.lit(1)).alias("rows"), *sums)
    merged = [x for i in range(width) for x in (F.sum(f"n{i}").alias(f"n{i}"), F.kll_merge_agg_double(f"s{i}", size).alias(f"s{i}"))]
    whole = leaves.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *merged)
    # parsed from text, as thousands of literal objects are slow to make
    ranks = ", ".join(repr(i / grid) + "D" for i in steps)
    quantiles = lambda i: F.expr(f"CASE WHEN n{i} > 0 THEN kll_sketch_get_quantile_double(s{i}, array({ranks})) END")
    return whole.select("rows", *[x for i in range(width) for x in (F.coalesce(f"n{i}", F.lit(0)).alias(f"n{i}"), quantiles(i).alias(f"g{i}"))]).first()


def add_ranges(df: DataFrame, cuts: dict[str, list[float]], outputs: dict[str, str]) -> DataFrame:
    """Add the range number of each column (a binary search in the JVM); missing values get NULL."""
    types = field_types(df)
    keys = {c: f"_key_{i}" for i, c in enumerate(cuts)}
    out = df.select("*", *[order_number(c, types[c]).alias(k) for c, k in keys.items()])
    out = Bucketizer(
        inputCols=list(keys.values()),
        outputCols=[outputs[c] for c in cuts],
        splitsArray=[[float("-inf"), *(cuts[c] or [0.0]), float("inf")] for c in cuts],
        handleInvalid="keep",
    ).transform(out)
    return out.drop(*keys.values())


def _ranged(df: DataFrame, order: Sequence[str], parts: int | None, spread_ties: bool) -> DataFrame:
    """Add ``_range`` and ``_part``, both rising with the order columns.

    Every cut point is a range of its own, so a value holding a third of the rows has a range for
    itself, and that range is cut again by the second order column.
    """
    types = field_types(df)
    first = order[0]
    if not _has_number(types[first]):
        # Text keys have no cheap cut points: let Spark range-partition them and fix the result.
        placed = df.repartitionByRange(parts or range_count(df), *map(quoted, order))
        return cut_lineage(placed.withColumn(RANGE, F.spark_partition_id().cast("long")).withColumn(PART, F.lit(0)))
    second = order[1] if spread_ties and len(order) > 1 and _has_number(types[order[1]]) else None
    cuts = cut_points(df, [first] if second is None else [first, second], parts)
    points = cuts[first]
    out = add_ranges(df, {first: points}, {first: RANGE}).withColumn(RANGE, F.col(RANGE).cast("long"))
    if second is None or not points:
        return out.withColumn(PART, F.lit(0))
    out = add_ranges(out, {second: cuts[second]}, {second: PART})
    on_cut = F.col(RANGE).between(1, len(points)) & (
        F.element_at(F.array(*map(F.lit, points)), F.greatest(F.col(RANGE), F.lit(1)).cast("int"))
        == order_number(first, types[first])
    )
    return out.withColumn(PART, F.when(on_cut, F.col(PART).cast("int")).otherwise(0)).withColumn(
        RANGE, F.col(RANGE) * 2 - on_cut.cast("long")
    )


def _group_key(by: Sequence[str]) -> Column:
    """The group columns as one column that is never NULL, so that joins keep groups with missing keys
    and reuse the partitioning of the windows."""
    return F.struct(*map(quoted, by)) if by else F.struct(F.lit(0).alias("all"))


def _offsets(counts: DataFrame, cells: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals of the earlier ranges and of the whole group, one row per (group, range)."""
    whole = Window.partitionBy(GROUP)
    before = whole.orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        GROUP,
        *cells,
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"_total_{s}") for s in sums],
    )


def ordered_index(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "idx",
    total: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Exact 0-based position of each row in the order of ``order`` (within ``by`` when given)."""
    staged = _ranged(df, order, parts, spread_ties=True)
    return _index(staged, order, by, [RANGE, PART], name, total)


def spread_index(
    df: DataFrame,
    order: Sequence[str],
    spread: Column,
    by: Sequence[str] = (),
    name: str = "idx",
    total: str | None = None,
) -> DataFrame:
    """Like :func:`ordered_index` for an order key whose range number is known, e.g. a hash."""
    staged = df.withColumn(RANGE, spread)
    return _index(staged, order, by, [RANGE], name, total)


def _index(staged, order, by, cells, name, total):
    keys = [GROUP, *cells]
    # rows without an order key sort first
    staged = staged.withColumns({GROUP: _group_key(by), RANGE: F.coalesce(RANGE, F.lit(-1).cast("long"))})
    counts = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    local = staged.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*map(quoted, order))).cast("long"))
    out = local.join(_offsets(counts, cells, ["n"]), keys)
    out = out.withColumn(name, F.col(name) + F.col("_before_n") - 1)
    if total:
        out = out.withColumn(total, F.col("_total_n"))
    return out.drop("_before_n", "_total_n", *keys)


def running_sums(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    cuts: list[float] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` (sum up to and including the row) and ``total_<s>`` for each named column.

    Rows must be unique per (``by``, ``order``): aggregate by the order key first.
    """
    points = cuts if cuts is not None else cut_points(df, [order], parts)[order]
    staged = add_ranges(df, {order: points}, {order: RANGE})
    staged = staged.withColumns({GROUP: _group_key(by), RANGE: F.coalesce(F.col(RANGE).cast("long"), F.lit(-1).cast("long"))})
    counts = staged.groupBy(GROUP, RANGE).agg(*[F.sum(s).alias(s) for s in sums])
    upto = Window.partitionBy(GROUP, RANGE).orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = staged.select("*", *[F.sum(s).over(upto).alias(f"cum_{s}") for s in sums])
    out = local.join(_offsets(counts, [RANGE], sums), [GROUP, RANGE])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"cum_{s}") + F.col(f"_before_{s}"))
        out = out.withColumnRenamed(f"_total_{s}", f"total_{s}").drop(f"_before_{s}")
    return out.drop(RANGE, GROUP)


def stacked_running(
    df: DataFrame,
    columns: Sequence[str],
    measures: dict[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    key: str = "column",
) -> DataFrame:
    """Distinct values of several numeric columns with running totals of the measures.

    One row per (``by``, ``column``, ``value``) with, for every measure ``m``: its sum ``m``, the sum
    ``cum_m`` up to and including the value, and the group's ``total_m``.
    """
    names = list(measures)
    ranges = {c: f"_r{i}" for i, c in enumerate(columns)}
    wide = add_ranges(df, cut_points(df, columns), ranges)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias(key),
                F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")).alias("value"),
                F.col(ranges[c]).cast("int").alias(RANGE),
            )
            for c in columns
        ]
    )
    keys = [*by, key]
    counted = (
        wide.select(*[F.col(quoted(b)) for b in by], *[e.alias(m) for m, e in measures.items()], F.inline(cells))
        .where(F.col("value").isNotNull())
        .groupBy(_group_key(keys).alias(GROUP), RANGE, "value")
        .agg(*[F.sum(m).alias(m) for m in names])
    )
    if descending:
        counted = counted.withColumn(RANGE, -F.col(RANGE))
    per_range = counted.groupBy(GROUP, RANGE).agg(*[F.sum(m).alias(m) for m in names])
    upto = (
        Window.partitionBy(GROUP, RANGE)
        .orderBy(F.desc("value") if descending else F.asc("value"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = counted.select("*", *[F.sum(m).over(upto).alias(f"cum_{m}") for m in names])
    placed = local.join(_offsets(per_range, [RANGE], names), [GROUP, RANGE])
    return placed.select(
        f"{GROUP}.*",
        "value",
        *names,
        *[(F.col(f"cum_{m}") + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in names],
        *[F.col(f"_total_{m}").alias(f"total_{m}") for m in names],
    )


def _sketch(df: DataFrame, columns: Sequence[str], grid: int) -> tuple[int, dict[str, tuple[int, list[float]]]]:
    """Row count, and per column its present-value count and an even grid of approximate quantiles; one pass."""
    types = field_types(df)
    base = df.select(*[as_double(c, types[c]).alias(f"x{i}") for i, c in enumerate(columns)])
    row = _grid_quantiles(base, len(columns), range(grid + 1), grid)
    return row["rows"], {c: (row[f"n{i}"], row[f"g{i}"] or []) for i, c in enumerate(columns)}


def order_statistics(
    df: DataFrame,
    columns: Sequence[str],
    ranks: Callable[[int, int], Sequence[int]],
    grid: int = 500,
) -> dict[str, tuple[int, dict[int, float]]]:
    """Exact values at 0-based ranks of the sorted present values: ``column -> (n, {rank: value})``.

    ``ranks(n, rows)`` names the ranks wanted of a column with ``n`` values in a table of ``rows`` rows.

    A sketch brackets every rank between two values; the second pass counts the rows below each bracket
    and lists only the values inside, so the shuffle carries a few thousandths of the column.
    """
    return _select_ranks(df, list(columns), lambda _c, n, rows: ranks(n, rows), grid)


def _select_ranks(df, columns, ranks, grid, parent=math.inf):
    if not columns:
        return {}
    rows, sketch = _sketch(df, columns, grid)
    wanted = {c: sorted(set(ranks(c, n, rows))) for c, (n, _) in sketch.items() if n}
    out: dict[str, tuple[int, dict[int, float]]] = {c: (n, {}) for c, (n, _) in sketch.items()}
    spans: dict[str, list[list[float]]] = {}
    inside: dict[str, list[list[int]]] = {}
    for c, rs in wanted.items():
        n, g = sketch[c]
        for r in rs:
            at = r * grid // max(n - 1, 1)
            lo, hi = g[max(at - 2, 0)], g[min(at + 3, grid)]
            if lo == hi:
                out[c][1][r] = lo  # one value fills the bracket
                continue
            hi = float(np.nextafter(hi, np.inf))
            mine = spans.setdefault(c, [])
            if mine and lo <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], hi)
                inside[c][-1].append(r)
            else:
                mine.append([lo, hi])
                inside.setdefault(c, []).append([r])
    if not spans:
        return out
    largest = max(sketch[c][0] for c in spans)
    # a bracket that hardly shrank is full of equal values, which the counting below merges
    if largest * 5 > grid * BRACKET_ROWS and largest * 2 <= parent:
        found = _refine(df, spans, inside, grid, largest)
    else:
        found = _read_brackets(df, spans, inside)
    for (c, r), value in found.items():
        out[c][1][r] = value
    for c, rs in wanted.items():
        if len(out[c][1]) < len(rs):
            raise ArithmeticError(f"a rank of {c} fell outside its bracket; use a finer grid")
    return out


def _refine(df, spans, inside, grid, parent):
    """Very large table: treat each bracket as a column of its own, which is some hundred times shorter."""
    types = field_types(df)
    cells = [(c, i) for c in spans for i in range(len(spans[c]))]
    x = {c: as_double(c, types[c]) for c in spans}
    below = df.agg(*[F.count_if(x[c] < spans[c][i][0]).alias(f"b{j}") for j, (c, i) in enumerate(cells)]).first()
    parts = df.select(*[F.when((x[c] >= spans[c][i][0]) & (x[c] < spans[c][i][1]), x[c]).alias(f"s{j}") for j, (c, i) in enumerate(cells)])
    local = {f"s{j}": [r - below[f"b{j}"] for r in inside[c][i]] for j, (c, i) in enumerate(cells)}
    values = _select_ranks(parts, list(local), lambda name, _n, _rows: local[name], grid, parent)
    return {(c, r): values[f"s{j}"][1][r - below[f"b{j}"]] for j, (c, i) in enumerate(cells) for r in inside[c][i]}


def _read_brackets(df, spans, inside):
    """Count what lies below each bracket, list the values in it, and pick the ranks."""
    types = field_types(df)
    at = {c: i for i, c in enumerate(spans)}
    base = df.select(*[as_double(c, types[c]).alias(f"x{i}") for c, i in at.items()])
    # ranges between the split points: even numbers are gaps, odd numbers are brackets
    base = Bucketizer(
        inputCols=[f"x{i}" for i in at.values()],
        outputCols=[f"z{i}" for i in at.values()],
        splitsArray=[[float("-inf"), *[v for span in spans[c] for v in span], float("inf")] for c in at],
        handleInvalid="keep",
    ).transform(base)
    cells = [
        F.struct(F.lit(c).alias(GROUP), F.col(f"z{i}").cast("int").alias("zone"), F.when(F.col(f"z{i}") % 2 == 1, F.col(f"x{i}")).alias("value"))
        for c, i in at.items()
    ]
    counted = base.select(F.inline(F.array(*cells))).where(F.col("zone").isNotNull()).groupBy(GROUP, "zone", "value").agg(F.count(F.lit(1)).alias("n"))
    zones = counted.groupBy(GROUP, "zone").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(GROUP, "zone").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = counted.where(F.col("value").isNotNull()).withColumn("last", F.sum("n").over(upto))
    placed = local.join(_offsets(zones, ["zone"], ["n"]), [GROUP, "zone"]).withColumnRenamed(GROUP, "column")
    last = F.col("last") + F.col("_before_n") - 1
    asked = {c: sorted(r for rs in inside[c] for r in rs) for c in spans}
    lists = F.create_map(*[x for c, rs in asked.items() for x in (F.lit(c), F.array(*[F.lit(r).cast("long") for r in rs]))])
    hit = placed.withColumns({"hi": last, "lo": last - F.col("n") + 1, "rs": lists[F.col("column")]})
    rows = hit.where(F.exists("rs", lambda r: r.between(F.col("lo"), F.col("hi")))).select("column", "value", "lo", "hi").collect()
    return {(r["column"], k): r["value"] for r in rows for k in asked[r["column"]] if r["lo"] <= k <= r["hi"]}


def quantile_ranks(n: int, probs: Sequence[float]) -> list[int]:
    """The ranks on both sides of each interpolated quantile of ``n`` values."""
    return [r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]


def interpolate(n: int, p: float, at: Callable[[int], float]) -> float:
    x = p * (n - 1)
    lo, hi = at(math.floor(x)), at(math.ceil(x))
    return lo + (hi - lo) * (x - math.floor(x))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolated quantiles: one row per (``by``, column) with ``n, q0, q1, ...``.

    Unlike the ``percentile`` aggregate no task holds all distinct values of a group.
    """
    if not by:
        stats = order_statistics(df, columns, lambda n, _: quantile_ranks(n, probs))
        rows = [(c, n, *[float(interpolate(n, p, v.__getitem__)) for p in probs]) for c, (n, v) in stats.items() if n]
        return df.sparkSession.createDataFrame(rows, "column string, n long, " + ", ".join(f"q{i} double" for i in range(len(probs))))
    keys = [*by, "column"]
    placed = stacked_running(df, columns, {"n": F.lit(1)}, by)
    last = F.col("cum_n") - 1
    first = F.col("cum_n") - F.col("n")
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when(rank.between(first, last), F.col("value"))).alias(f"{side}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"frac{i}"))
    found = placed.groupBy(*map(quoted, keys)).agg(*picks, F.max("total_n").alias("n"))
    return found.select(
        *map(quoted, keys),
        "n",
        *[
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"frac{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ],
    )


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """One exact median per column that has a value."""
    stats = order_statistics(df, columns, lambda n, _: quantile_ranks(n, [0.5]))
    return {c: float(interpolate(n, 0.5, v.__getitem__)) for c, (n, v) in stats.items() if n}


def filled_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, tuple[float, list[float]]]:
    """Median of each column and the quantiles the column has once its gaps hold that median.

    The copies of the median sit together in the sorted filled column, so its ranks translate to ranks of
    the present values and one pass serves both.
    """
    size = {}

    def below(n: int) -> int:
        return math.floor((n - 1) / 2) + 1

    def translate(r: int, n: int, rows: int) -> int | None:
        return r if r < below(n) else None if r < below(n) + rows - n else r - (rows - n)

    def ranks(n: int, rows: int) -> list[int]:
        size["rows"] = rows
        asked = [translate(r, n, rows) for r in quantile_ranks(rows, probs)]
        return [*quantile_ranks(n, [0.5]), *[r for r in asked if r is not None]]

    out = {}
    for c, (n, v) in order_statistics(df, columns, ranks).items():
        if not n:
            out[c] = (0.0, [0.0] * len(probs))
            continue
        middle, rows = float(interpolate(n, 0.5, v.__getitem__)), size["rows"]

        def at(r: int, n=n, v=v, middle=middle, rows=rows) -> float:
            k = translate(r, n, rows)
            return middle if k is None else v[k]

        out[c] = (middle, [float(interpolate(rows, p, at)) for p in probs])
    return out


def neighbour_chunks(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str],
    before: int = 0,
    after: int = 0,
    size: int = 50_000,
) -> tuple[DataFrame, Window]:
    """Cut each group into chunks that overlap by the rows a bounded window frame can reach.

    Returns the frame (``_chunk``, ``_own`` and ``_idx`` added) and the window to use on it.  Keep
    the rows with ``_own`` after applying functions that look at most ``before`` rows back and
    ``after`` rows ahead: each chunk holds at most ``size + before + after`` rows, however large the
    group is.
    """
    if size < max(before, after, 1):
        raise ValueError("a chunk must be at least as long as the reach of the frame")
    placed = ordered_index(df, order, by, name="_idx")
    home = F.floor(F.col("_idx") / size)
    offset = F.col("_idx") % size
    none = F.array().cast("array<bigint>")
    homes = F.concat(
        F.array(home),
        F.when((offset < after) & (home > 0), F.array(home - 1)).otherwise(none),
        F.when(offset >= size - before, F.array(home + 1)).otherwise(none),
    )
    out = placed.select("*", F.explode(homes).alias("_chunk")).withColumn("_own", F.col("_chunk") == home)
    return out, Window.partitionBy(*map(quoted, by), "_chunk").orderBy("_idx")
