"""Feature/target association: identity, mutual information, correlation ratio, leakage, ranking."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbrule.core.frames import (
    _slots,
    as_double,
    broadcast_if_small,
    categorical_columns,
    column_rows,
    field_types,
    is_numeric,
    long_values,
    numeric_columns,
    quoted,
    value_of,
)
from plumbrule.core.ordering import filled_quantiles, medians, neighbour_chunks, ordered_index, running_sums
from plumbrule.core.session import cut_lineage
from plumbrule.functions.significance import f_sf
from plumbrule.operators.neighbours import chebyshev, nearest
from plumbrule.operators.profile import column_stats
from plumbrule.operators.schema_rules import issue, issues_from

SLOTS = ("lval", "dval", "sval")
BINS = 10
SMALL = 100_000
BINNED = "_binned_"


def add_bins(df: DataFrame, columns: Sequence[str], bins: int = BINS, prefix: str = BINNED) -> DataFrame:
    """Add ``<prefix><c>``: number of equal-frequency edges at or below the value; missing takes the median."""
    columns = list(columns)
    if not columns:
        return df
    types = field_types(df)
    facts = filled_quantiles(df, columns, [i / bins for i in range(1, bins)])
    filled = df.select("*", *[F.coalesce(as_double(c, types[c]), F.lit(facts[c][0])).alias(f"_fill_{i}") for i, c in enumerate(columns)])
    named = {f"_fill_{i}": c for i, c in enumerate(columns)}
    out = Bucketizer(
        inputCols=list(named),
        outputCols=[prefix + c for c in named.values()],
        splitsArray=[[float("-inf"), *sorted(set(facts[c][1])), float("inf")] for c in named.values()],
    ).transform(filled)
    return out.drop(*named).withColumns({prefix + c: F.col(quoted(prefix + c)).cast("int") for c in columns})


def pair_counts(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``column, <value slots>, is_missing, t_l, t_d, t_s, n``: contingency tables of all features at once."""
    slots = _slots(target, field_types(df)[target])
    keep = [s.alias(n) for s, n in zip(slots, ("t_l", "t_d", "t_s"))]
    return long_values(df, features, keep).groupBy("column", *SLOTS, "is_missing", "t_l", "t_d", "t_s").agg(
        F.count(F.lit(1)).alias("n")
    )


def association_facts(counts: DataFrame) -> DataFrame:
    """Per column, from the contingency tables alone: mutual information and the pair, value and class counts.

    MI = (sum n_xy ln n_xy - sum n_x ln n_x - sum n_y ln n_y) / n + ln n.  The tables are grouped by pairs already,
    so one more grouping by value and one by class are enough.
    """
    n = F.col("n")
    by_x = counts.groupBy("column", *SLOTS, "is_missing").agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("pairs"), F.sum(n * F.ln(n)).alias("w"))
    by_y = counts.groupBy("column", "t_l", "t_d", "t_s").agg(F.sum(n).alias("n"), F.coalesce(F.sum(F.when(~F.col("is_missing"), n)), F.lit(0)).alias("n_ok"))
    x = by_x.groupBy("column").agg(
        F.sum(n).alias("n"),
        F.sum(F.col("w") - n * F.ln(n)).alias("w"),
        F.coalesce(F.sum(F.when(~F.col("is_missing"), F.col("pairs"))), F.lit(0)).alias("n_pairs"),
        F.count_if(~F.col("is_missing")).alias("n_values"),
    )
    y = by_y.groupBy("column").agg(F.sum(n * F.ln(n)).alias("wy"), F.count_if(F.col("n_ok") > 0).alias("n_classes_seen"), F.count(F.lit(1)).alias("n_classes"))
    mi = F.greatest((F.col("w") - F.col("wy")) / n + F.ln(n), F.lit(0.0))
    return x.join(F.broadcast(y), "column").withColumn("mi", mi).drop("w", "wy")  # one row per column


def one_class_columns(df: DataFrame, features: Sequence[str], target: str) -> set[str]:
    """Columns in which no value goes with two classes; a shared hash may let in a column that does not belong.

    Only values are grouped, not pairs, so that a column of few values costs nothing but its scan.
    """
    if not features:
        return set()
    lval, dval, sval = _slots(target, field_types(df)[target])
    y = F.xxhash64(lval, dval + F.lit(0.0), sval)
    cells = long_values(df, features, [y.alias("y")]).where(~F.col("is_missing"))
    values = cells.groupBy("column", *SLOTS).agg(F.min("y").alias("a"), F.max("y").alias("b"))
    found = values.groupBy("column").agg(F.bool_and(F.col("a") == F.col("b")).alias("one"))
    return {r["column"] for r in found.where("one").collect()}


def copies_of_target(df: DataFrame, features: Sequence[str], target: str) -> set[str]:
    """:func:`identical_columns` of features whose contingency tables are not at hand."""
    left = one_class_columns(df, features, target)
    names = [c for c in features if c in left]
    if not names:
        return set()
    counts = cut_lineage(pair_counts(df, names, target))
    return identical_columns(df, target, association_facts(counts).collect(), counts)


def keeps_order(pairs: DataFrame, size: int) -> bool:
    """Does sorting distinct one-to-one (value, class) pairs by value also sort them by class?"""
    both = pairs.select(F.struct(*SLOTS).alias("f"), F.struct("t_l", "t_d", "t_s").alias("t"))
    if size <= SMALL:
        ranks = both.select(
            F.row_number().over(Window.orderBy("f")).alias("rf"), F.row_number().over(Window.orderBy("t")).alias("rt")
        )
    else:
        by_f = ordered_index(both, ["f"], name="rf")
        ranks = ordered_index(by_f, ["t"], name="rt")
    return ranks.where(F.col("rf") != F.col("rt")).isEmpty()


def identical_columns(df: DataFrame, target: str, facts: Sequence, counts: DataFrame) -> set[str]:
    """Columns whose sorted distinct values pair off with the sorted classes, row by row.

    The counts rule out nearly all columns; of the others, with as many pairs as values and classes, the pairs are compared.
    """
    found = set()
    for r in facts:
        if 0 < r["n_pairs"] == r["n_values"] == r["n_classes_seen"]:
            pairs = counts.where((F.col("column") == r["column"]) & ~F.col("is_missing"))
            if keeps_order(pairs, r["n_pairs"]):
                found.add(r["column"])
    return found


def correlations(df: DataFrame, features: Sequence[str], target: str) -> dict[str, float | None]:
    """Pearson correlation of each numeric feature with the numeric target over rows holding both."""
    types = field_types(df)
    y = as_double(target, types[target])

    def one(c):
        x = as_double(c, types[c])
        both = x.isNotNull() & y.isNotNull()
        return F.corr(F.when(both, x), F.when(both, y))

    if not features:
        return {}
    rows = column_rows(df, features, {"r": {c: one(c) for c in features}}).collect()
    return {r["column"]: None if r["r"] is None or math.isnan(r["r"]) else float(r["r"]) for r in rows}


def correlation_ratios(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Eta squared of the numeric target given each feature: ``column, eta2``."""
    y = as_double(target, field_types(df)[target])
    cells = long_values(df, features, [y.alias("y")]).where(~F.col("is_missing") & F.col("y").isNotNull())
    groups = cells.groupBy("column", *SLOTS).agg(
        F.count("y").alias("n"), F.avg("y").alias("m"), (F.var_pop("y") * F.count("y")).alias("within")
    )
    means = groups.groupBy("column").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    between = F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu")))
    total = between + F.sum("within")
    return (
        groups.join(F.broadcast(means), "column")  # one row per column
        .groupBy("column")
        .agg(F.when(total > 0, between / total).otherwise(0.0).alias("eta2"))
        .withColumn("eta2", F.least(F.greatest("eta2", F.lit(0.0)), F.lit(1.0)))
    )


def identity_scores(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """1.0 for features that copy the target (order-preserving codes or correlation beyond 0.999), else 0.0."""
    names = list(features or [c for c in df.columns if c != target])
    usable = df.where(value_of(target, field_types(df)[target]).isNotNull())
    counts = cut_lineage(pair_counts(usable, names, target))
    facts = association_facts(counts).collect()
    same = identical_columns(usable, target, facts, counts) | _correlated(usable, names, target)
    rows = [(c, 1.0 if c in same else 0.0) for c in names]
    return df.sparkSession.createDataFrame(rows, "column string, identity_score double")


def _correlated(df: DataFrame, names: Sequence[str], target: str) -> set[str]:
    if not is_numeric(field_types(df)[target]):
        return set()
    numbers = [c for c in numeric_columns(df) if c in names]
    return {c for c, r in correlations(df, numbers, target).items() if r is not None and abs(r) > 0.999}


def leakage_scores(df: DataFrame, target: str, task: str, bins: int | None = None) -> DataFrame:
    """Association of each feature with the target on [0, 1]: ``column, score``.

    For classes that is the information divided by the logarithm of their number, of numbers by nearest
    neighbours (by equal-frequency bins if ``bins`` is given).
    """
    task = task.strip().lower()
    if target not in df.columns:
        raise ValueError(f"unknown target column: {target}")
    if task not in ("classification", "regression"):
        raise ValueError("task must be classification or regression")
    usable = df.where(value_of(target, field_types(df)[target]).isNotNull())
    names = [c for c in df.columns if c != target]
    score = _class_scores(usable, names, target, bins) if task == "classification" else _number_scores(usable, names, target)
    return df.sparkSession.createDataFrame([(c, float(score[c])) for c in names], "column string, score double")


def _class_scores(df: DataFrame, names: list[str], target: str, bins: int | None) -> dict[str, float]:
    numbers = [c for c in numeric_columns(df) if c in names]
    texts = [c for c in names if c not in numbers]
    classes = df.select(*_slots(target, field_types(df)[target])).distinct().count()
    if classes < 2:
        return dict.fromkeys(names, 0.0)
    binned = add_bins(df, numbers, bins) if bins else df
    counts = cut_lineage(pair_counts(binned, [*texts, *([BINNED + c for c in numbers] if bins else [])], target)) if texts or bins else None
    facts = {r["column"]: r for r in association_facts(counts).collect()} if counts is not None else {}
    same = _correlated(df, names, target)
    same |= identical_columns(df, target, [facts[c] for c in texts], counts) | copies_of_target(df, [c for c in numbers if c not in same], target)
    asked = [c for c in numbers if c not in same]
    near = {} if bins or not asked else {r["feature"]: r["mutual_information"] for r in nearest_information(df, target, asked).collect()}
    out = {}
    for c in names:
        if c in same:
            out[c] = 1.0
        elif c not in numbers and facts[c]["n_values"] / facts[c]["n"] > 0.50:
            out[c] = 0.0
        else:
            mi = facts[c]["mi"] if c not in numbers else facts[BINNED + c]["mi"] if bins else near.get(c, 0.0)
            out[c] = min(1.0, max(0.0, mi / math.log(classes)))
    return out


def _number_scores(df: DataFrame, names: list[str], target: str) -> dict[str, float]:
    if not is_numeric(field_types(df)[target]):
        raise ValueError("a regression target must be numeric")
    numbers = [c for c in numeric_columns(df) if c in names]
    texts = [c for c in categorical_columns(df) if c in names]
    r = correlations(df, numbers, target)
    same = copies_of_target(df, [c for c in names if abs(r.get(c) or 0.0) <= 0.999], target)
    eta = {x["column"]: x["eta2"] for x in correlation_ratios(df, texts, target).collect()} if texts else {}
    out = {}
    for c in names:
        if c in same or abs(r.get(c) or 0.0) > 0.999:
            out[c] = 1.0
        else:
            out[c] = abs(r.get(c) or 0.0) if c in numbers else eta.get(c, 0.0)
    return out


def leakage_issues(df: DataFrame, target: str, task: str) -> DataFrame:
    s, c = F.col("score"), F.col("column")
    return issues_from(
        leakage_scores(df, target, task),
        [
            F.when(s > 0.95, issue("error", "leakage", c, "leak_extreme", s))
            .when(s >= 0.80, issue("warning", "leakage", c, "leak_very_strong", s))
            .when(s >= 0.60, issue("info", "leakage", c, "leak_strong", s))
        ],
    )


def feature_information(df: DataFrame, target: str, features: Sequence[str], bins: int | None = None, task: str = "classification") -> DataFrame:
    """Mutual information (nats) of every feature with the target: ``feature, mutual_information``.

    Numbers, filled by their median, are judged by nearest neighbours, against classes as well as against a
    numeric target (``task="regression"``); texts count as classes.  With ``bins`` numbers are binned by equal
    frequency instead, which caps their information at the logarithm of the number of bins.
    """
    types = field_types(df)
    usable = df.where(value_of(target, types[target]).isNotNull())
    numbers = [c for c in features if is_numeric(types[c])]
    texts = [c for c in features if c not in numbers]
    if task == "regression":
        parts = ([pair_information(usable, target, numbers)] if numbers else []) + ([text_information(usable, target, texts)] if texts else [])
    else:
        frame = add_bins(usable, numbers, bins) if bins else usable
        names = {c: c for c in texts} | ({BINNED + c: c for c in numbers} if bins else {})
        parts = [nearest_information(usable, target, numbers)] if numbers and not bins else []
        if names:
            lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
            facts = association_facts(pair_counts(frame, list(names), target))
            parts.append(facts.select(lookup[F.col("column")].alias("feature"), F.col("mi").alias("mutual_information")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, mutual_information double")
    return functools.reduce(DataFrame.unionByName, parts)


def digamma(x: Column) -> Column:
    """Digamma function for x >= 1: shift by six, then the asymptotic series."""
    y = x + 6.0
    shift = sum((1.0 / (x + float(j)) for j in range(6)), F.lit(0.0))
    z = 1.0 / (y * y)
    return F.ln(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - shift


#: Part of a radius that a range count leaves out, so that the neighbour at the radius itself is never counted.
OPEN_END = 1e-9


def _counted_inside(asked: DataFrame, line: DataFrame, value: str, name: str) -> DataFrame:
    """Add ``name``: rows of ``line`` (``column, spot, n``) nearer to ``value`` than ``r``; at ``value`` itself where ``r`` is 0.

    Both ends of a range become spots on the line, and two running counts differ by what lies between them.
    """
    room = F.col("r") * (1.0 - OPEN_END)
    asked = cut_lineage(asked.withColumns({"_lo": F.col(value) - room, "_hi": F.col(value) + room}))
    spots = asked.select("column", F.explode(F.array("_lo", "_hi")).alias("spot"), F.lit(0).cast("long").alias("n"))
    sums = line.select("column", "spot", "n").unionByName(spots).groupBy("column", "spot").agg(F.sum("n").alias("n"))
    sums = cut_lineage(running_sums(sums, "spot", ["n"], by=["column"]))
    below = sums.select("column", F.col("spot").alias("_lo"), (F.col("cum_n") - F.col("n")).alias("_before"))
    above = sums.select("column", F.col("spot").alias("_hi"), F.col("cum_n").alias("_upto"))
    met = asked.join(below, ["column", "_lo"]).join(above, ["column", "_hi"])
    return met.withColumn(name, F.greatest(F.col("_upto") - F.col("_before"), F.lit(1))).drop("_lo", "_hi", "_upto", "_before")


def _kth_distance(sides: str, k: Column) -> Column:
    """Distance at which ``k`` other rows are reached: first the copies of the row, then ``sides`` (d, n) from near to far."""
    start = F.struct((F.col("n") - 1).alias("seen"), F.lit(0.0).alias("r"))
    return F.aggregate(sides, start, lambda a, s: F.when(a["seen"] >= k, a).otherwise(F.struct((a["seen"] + s["n"]).alias("seen"), s["d"].alias("r"))))["r"]


def _class_information(cells: DataFrame, k: int) -> DataFrame:
    """Nearest-neighbour information of ``value`` with ``label`` for every ``column``: ``feature, mutual_information``."""
    counts = cut_lineage(cells.groupBy("column", "label", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.groupBy("column", "label").agg(F.sum("n").alias("size")).where("size > 1")
    # classes of one row have no neighbour and are left out of everything
    counts = cut_lineage(counts.join(broadcast_if_small(sizes), ["column", "label"]))
    chunks, w = neighbour_chunks(counts, ["value"], ["column", "label"], before=k, after=k)
    other = [F.struct(F.abs(fn("value", j).over(w) - F.col("value")).alias("d"), fn("n", j).over(w).alias("n")) for j in range(1, k + 1) for fn in (F.lag, F.lead)]
    sides = F.array_sort(F.filter(F.array(*other), lambda s: s["d"].isNotNull()))
    placed = chunks.withColumn("sides", sides).where("_own").drop("_own", "_chunk", "_idx").withColumn("k", F.least(F.lit(k), F.col("size") - 1))
    asked = placed.withColumn("r", _kth_distance("sides", F.col("k"))).select("column", "value", "n", "size", "k", "r")
    # copies of one class only tell that class for certain, so at radius 0 the copies take the place of the neighbours
    asked = asked.withColumn("k", F.when(F.col("r") > 0, F.col("k")).otherwise(F.col("n")))
    line = counts.select("column", F.col("value").alias("spot"), "n")
    both = _counted_inside(asked, line, "value", "m")
    n = F.col("n")
    terms = both.groupBy("column").agg(
        F.sum(n).cast("double").alias("rows"), *[F.sum(n * digamma(F.col(c).cast("double"))).alias(f"d_{c}") for c in ("k", "size", "m")]
    )
    mi = digamma(F.col("rows")) + (F.col("d_k") - F.col("d_size") - F.col("d_m")) / F.col("rows")
    return terms.select(F.col("column").alias("feature"), F.greatest(mi, F.lit(0.0)).alias("mutual_information"))


def nearest_information(df: DataFrame, target: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """Nearest-neighbour mutual information of numeric features with the classes: ``feature, mutual_information``.

    Equal values are merged first.  The distance of a value to its k-th neighbour of the same class comes
    from the k values on either side; the rows of any class within that distance are the difference of two
    running counts, so neither pairs nor whole classes are ever gathered.  Missing values take the median.
    """
    types = field_types(df)
    names = list(features)
    usable = df.where(value_of(target, types[target]).isNotNull())
    middle = medians(usable, names)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(as_double(c, types[c]), F.lit(middle.get(c, 0.0))).alias("value")) for c in names])
    return _class_information(usable.select(F.col(quoted(target)).alias("label"), F.inline(cells)), k)


def text_information(df: DataFrame, target: str, features: Sequence[str], k: int = 3) -> DataFrame:
    """The same of text features with a numeric target: the texts are the classes, a missing one is a class of its own."""
    types = field_types(df)
    y = as_double(target, types[target])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(quoted(c)).cast("string"), F.lit("<MISSING>")).alias("label")) for c in features])
    return _class_information(df.where(y.isNotNull()).select(y.alias("value"), F.inline(cells)), k)


def pair_information(df: DataFrame, target: str, features: Sequence[str], k: int = 3, block_rows: int = 512) -> DataFrame:
    """Nearest-neighbour mutual information of numeric features with a numeric target: ``feature, mutual_information``.

    Both axes are divided by their standard deviations, missing features take the median.  The k nearest rows in
    the plane, by the larger of both gaps, give each row its radius; the rows nearer than that on either axis are
    counted on the line.  Equal points are merged; where k copies lie at a point the copies there are compared
    with the copies of its values, which is the plain estimate for discrete numbers.  A constant tells nothing.
    """
    types = field_types(df)
    names = list(features)
    usable = df.where(as_double(target, types[target]).isNotNull())
    middle = medians(usable, names)
    filled = usable.select(as_double(target, types[target]).alias("_y"), *[F.coalesce(as_double(c, types[c]), F.lit(middle.get(c, 0.0))).alias(f"_x{i}") for i, c in enumerate(names)])
    spread = filled.agg(F.stddev_pop("_y").alias("_y"), *[F.stddev_pop(f"_x{i}").alias(f"_x{i}") for i in range(len(names))]).first()
    scaled = lambda c: F.col(c) / F.lit(spread[c] or 1.0) + F.lit(0.0)
    cells = F.array(*[F.struct(F.lit(i).alias("g"), scaled(f"_x{i}").alias("x")) for i in range(len(names))])
    counts = filled.select(scaled("_y").alias("y"), F.inline(cells)).groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.withColumn("id", F.monotonically_increasing_id()))
    points = counts.select("id", "g", F.array("x", "y").alias("v"))
    # a point is held against the bounds of all blocks and the rows of some, so both numbers grow with the root of the points
    block_rows = max(block_rows, math.isqrt(counts.count() // 2))
    near = nearest(points, points, k, exclude_self=True, block_rows=block_rows, metric=chebyshev)
    sides = near.join(counts.select(F.col("id").alias("neighbour"), "n"), "neighbour").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("distance").alias("d"), "n"))).alias("sides"))
    rows = counts.groupBy("g").agg(F.sum("n").alias("rows")).agg(F.max("rows")).first()[0] or 0
    few = F.lit(max(min(k, rows - 1), 0))
    placed = counts.join(sides, "id", "left").withColumn("sides", F.coalesce("sides", F.array()))
    asked = placed.withColumn("r", _kth_distance("sides", few)).select(F.col("g").alias("column"), "x", "y", "n", "r")
    asked = asked.withColumn("k", F.when(F.col("r") > 0, few).otherwise(F.col("n")))
    for axis in ("x", "y"):
        line = counts.groupBy(F.col("g").alias("column"), F.col(axis).alias("spot")).agg(F.sum("n").alias("n"))
        asked = _counted_inside(asked, line, axis, f"n_{axis}")
    n = F.col("n")
    terms = asked.groupBy("column").agg(F.sum(n).cast("double").alias("rows"), *[F.sum(n * digamma(F.col(c).cast("double"))).alias(f"d_{c}") for c in ("k", "n_x", "n_y")])
    mi = digamma(F.col("rows")) + (F.col("d_k") - F.col("d_n_x") - F.col("d_n_y")) / F.col("rows")
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("column") + 1)
    return terms.select(named.alias("feature"), F.greatest(mi, F.lit(0.0)).alias("mutual_information"))


def rank_features(df: DataFrame, target: str, features: Sequence[str], top_n: int | None = 12, task: str = "classification") -> DataFrame:
    """Features by their information about the target, the most telling first; ``None`` lists all."""
    ranked = feature_information(df, target, features, task=task).orderBy(F.desc("mutual_information"), "feature")
    return ranked.limit(top_n) if top_n is not None else ranked


def recommend_features(df: DataFrame, target: str, features: Sequence[str], information: DataFrame | None = None, task: str = "classification") -> DataFrame:
    """Quality score and a Strong / Moderate / Weak / Remove verdict per feature."""
    usable = df.where(value_of(target, field_types(df)[target]).isNotNull())
    info = information if information is not None else feature_information(df, target, features, task=task)
    stats = column_stats(usable, list(features)).select(
        F.col("column").alias("feature"), "dtype", F.col("distinct_values").alias("unique"), "missing_pct"
    )
    joined = stats.join(info, "feature", "left").fillna(0.0, subset=["mutual_information"])
    top = F.greatest(F.max("mutual_information").over(Window.partitionBy()), F.lit(1e-12))
    share = F.col("mi_of_max")
    verdict = (
        F.when(F.col("unique") <= 1, "Remove")
        .when(F.col("missing_pct") >= 0.5, "Weak")
        .when(share >= 0.65, "Strong")
        .when(share >= 0.25, "Moderate")
        .otherwise("Weak")
    )
    why = (
        F.when(F.col("unique") <= 1, "one value at most")
        .when(F.col("missing_pct") >= 0.5, "half or more missing")
        .when(share >= 0.65, "strong relation to the target")
        .when(share >= 0.25, "some relation to the target")
        .otherwise("little relation to the target")
    )
    return (
        joined.withColumn("mi_of_max", F.col("mutual_information") / top)
        .withColumn("quality_score", 0.8 * share + 0.2 * (1 - F.col("missing_pct")))
        .select("feature", "dtype", "unique", "missing_pct", "mutual_information", "quality_score", verdict.alias("recommendation"), why.alias("reason"))
        .orderBy(F.desc("quality_score"), F.desc("mutual_information"), "feature")
    )


def compact_features(recommended: DataFrame) -> list[str]:
    """Names of the Strong and Moderate features (one per column at most)."""
    rows = recommended.where(F.col("recommendation").isin("Strong", "Moderate")).select("feature").collect()
    return [r["feature"] for r in rows]


def feature_diagnostics(df: DataFrame, target: str, features: Sequence[str], information: DataFrame | None = None, task: str = "classification") -> DataFrame:
    usable = df.where(value_of(target, field_types(df)[target]).isNotNull())
    info = information if information is not None else feature_information(df, target, features, task=task)
    stats = column_stats(usable, list(features)).select(
        F.col("column").alias("feature"), "missing_pct", F.col("distinct_values").alias("unique"), "dtype"
    )
    total = F.greatest(F.sum("mutual_information").over(Window.partitionBy()), F.lit(1e-12))
    return (
        stats.join(info, "feature", "left")
        .fillna(0.0, subset=["mutual_information"])
        .withColumn("mi_share", F.col("mutual_information") / total)
        .orderBy(F.desc("mutual_information"), "feature")
    )


def class_codes(df: DataFrame, target: str) -> DataFrame:
    """Distinct labels with their 0-based code in text order: ``label, code``."""
    labels = df.where(F.col(quoted(target)).isNotNull()).select(F.col(quoted(target)).cast("string").alias("label")).distinct()
    if labels.limit(SMALL + 1).count() > SMALL:
        return ordered_index(labels, ["label"], name="code")
    return labels.withColumn("code", F.row_number().over(Window.orderBy("label")).cast("long") - 1)


def target_associations(df: DataFrame, target: str, features: Sequence[str], information: DataFrame | None = None, task: str = "classification") -> DataFrame:
    """Pearson correlation of median-filled numeric features with the (encoded) target."""
    types = field_types(df)
    usable = df.where(value_of(target, types[target]).isNotNull())
    numbers = [c for c in features if is_numeric(types[c])]
    middle = medians(usable, numbers)
    if is_numeric(types[target]):
        coded = usable.withColumn("_y", as_double(target, types[target]))
    else:
        codes = class_codes(usable, target)
        coded = usable.join(broadcast_if_small(codes), usable[target].cast("string") == codes["label"]).withColumn("_y", F.col("code").cast("double"))
    filled = coded.select("_y", *[F.coalesce(as_double(c, types[c]), F.lit(middle.get(c, 0.0))).alias(c) for c in numbers])
    r = {c: v or 0.0 for c, v in correlations(filled, numbers, "_y").items()}
    rows = df.sparkSession.createDataFrame([(c, abs(r[c]), r[c]) for c in numbers], "feature string, abs_target_correlation double, target_correlation double")
    info = information if information is not None else feature_information(df, target, numbers, task=task)
    return (
        rows.join(info, "feature", "left")
        .fillna(0.0, subset=["mutual_information"])
        .orderBy(F.desc("abs_target_correlation"), F.desc("mutual_information"), "feature")
    )


def anova_f(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """One-way F statistic and p-value of each numeric feature over the classes of ``label``."""
    types = field_types(df)
    wide = df.where(F.col(quoted(label)).isNotNull()).groupBy(F.col(quoted(label)).alias("label")).agg(
        *[
            x
            for i, c in enumerate(features)
            for x in (
                F.count(as_double(c, types[c])).alias(f"n{i}"),
                F.avg(as_double(c, types[c])).alias(f"m{i}"),
                F.var_pop(as_double(c, types[c])).alias(f"v{i}"),
            )
        ]
    )
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v"))
        for i, c in enumerate(features)
    ]
    groups = wide.select(F.inline(F.array(*cells))).where(F.col("n") > 0)
    means = groups.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    gap = F.col("m") - F.col("mu")
    table = (
        groups.join(F.broadcast(means), "feature")  # one row per feature
        .groupBy("feature")
        .agg(
            F.sum(F.col("n") * gap * gap).alias("between"),
            F.sum(F.col("n") * F.col("v")).alias("within"),
            (F.count(F.lit(1)) - 1).alias("df_between"),
            (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
        )
    )
    f = F.try_divide(F.col("between") / F.col("df_between"), F.col("within") / F.col("df_within"))
    p = F.col("p_value")
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    return (
        table.withColumn("f_score", f)
        .withColumn("p_value", f_sf("f_score", F.col("df_between").cast("double"), F.col("df_within").cast("double")))
        .withColumn("stars", stars)
        .select("feature", "f_score", "p_value", "stars", "df_between", "df_within")
        .orderBy(F.desc("f_score"), "feature")
    )


def complete_validation(new: DataFrame, target: str, task: str, reference: DataFrame | None = None) -> DataFrame:
    """Schema, leakage (if the target exists) and drift (if a reference is given) findings, worst first."""
    from plumbrule.operators.drift import drift_issues
    from plumbrule.operators.schema_rules import schema_issues, sorted_issues

    found = schema_issues(new, target)
    if target in new.columns:
        found = found.unionByName(leakage_issues(new, target, task))
    if reference is not None:
        found = found.unionByName(drift_issues(reference, new, target))
    return sorted_issues(found)
