"""Mixing of sources to target weights by capped water-filling.

The targets follow from one small table of sources; documents are then chosen by a seeded hash.  Within a
source the documents stand in hash order, and the fractional repetition takes them from the start until its
share of words is reached.  The end of that run is found from two levels of hash bins, so no task ever holds
the documents of a source: the bins are sums with map-side combination, and only the documents of one fine
bin per source are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from plumbrule.core.ordering import ordered_index
from plumbrule.core.session import cut_lineage

#: White space of the words that are counted.
SPACES = " \t\n\x0b\x0c\r"
WORDS = "[^\\x20\\x09-\\x0D]+"
BINS = 4096


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place(key: Column, seed: int) -> Column:
    """A fixed pseudo-random whole number below 2**60 for each document."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Give the sources, in order of their code points and NULL last, the weights in turn."""
    keyed = sizes.withColumn("absent", F.col("source").isNull().cast("int"))
    order = ordered_index(keyed.where("absent = 0").select("source"), ["source"], name="number").withColumn("number", F.col("number").cast("long"))
    known = keyed.where("absent = 0").join(order, "source")
    last = keyed.where("absent = 1").withColumn("number", order.agg(F.count(F.lit(1))).scalar())
    numbered = known.unionByName(last)
    turn = F.pmod(F.col("number"), F.lit(len(weights))).cast("int")
    return numbered.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("weight"))


def water_fill(weighted: DataFrame, total: float, epochs: float) -> DataFrame:
    """Add ``target``: shares of ``total`` by weight, none above ``epochs`` times its source's size.

    Each round gives what is left to the open sources by weight and closes those that would pass their
    limit; the round without a new one is the last.  A round is one sum over the table of sources.
    If all sources close, ``total`` cannot be reached and every target is its limit.
    """

    def filled(level: float) -> Row:
        closed = F.col("weight") * level >= F.col("source_size") * epochs
        return weighted.agg(
            F.sum(F.when(closed, F.col("source_size") * epochs)).alias("spent"),
            F.sum(F.when(~closed, F.col("weight"))).alias("open"),
            F.count(F.when(closed, 1)).alias("n"),
        ).first()

    level = 0.0
    row = filled(level)
    while True:
        if not row["open"]:
            return weighted.withColumn("target", F.col("source_size") * F.lit(float(epochs)))
        level = max(level, (total - (row["spent"] or 0.0)) / row["open"])
        before, row = row, filled(level)
        if row["n"] == before["n"]:
            break
    return weighted.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * F.lit(float(epochs))))


def _reached(sums: DataFrame, by: list[str], slot: str, wanted: str) -> DataFrame:
    """The bin of each group in which the running sum passes the wanted number of words."""
    order = Window.partitionBy(*by).orderBy(slot)
    before = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    return run.where((F.col("before") < F.col(wanted)) & (F.col("before") + F.col("words") >= F.col(wanted)))


def mix_sources(
    docs: DataFrame,
    *,
    budget: float = 1.5,
    epochs: float = 2.0,
    weights: tuple[int, ...] = (3, 1, 2),
    seed: int = 11,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id, size, source, source_size, target, whole, taken`` of every row.

    ``taken`` is ``size`` times the repetitions of the document: the whole ones of its source, and one more
    for documents that the fractional repetition reaches.  The last of these is the one that brings the sum
    nearest to the target.  NULL is a source of its own.  Empty and NULL texts have size 0 and take nothing;
    rows with the same key share their place in the order; a source of empty texts has target 0; an empty
    table gives an empty result.
    """
    rows = cut_lineage(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            place(F.col(key), seed).alias("place"),
        )
    )
    coarse = F.shiftright("place", 48).cast("int")
    fine = F.shiftright("place", 36).bitwiseAND(BINS - 1).cast("int")
    rows = rows.withColumns({"coarse": coarse, "fine": fine})
    bins = cut_lineage(rows.groupBy("source", "coarse").agg(F.sum("size").alias("words")))
    sizes = cut_lineage(bins.groupBy("source").agg(F.sum("words").alias("source_size")))
    total = (sizes.agg(F.sum("source_size")).first()[0] or 0) * budget
    # the rounds read the weights, they do not put the sources in order again
    weighted = cut_lineage(source_weights(sizes, weights))
    targets = water_fill(weighted, total, epochs).withColumn("target", F.round("target", 6))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = cut_lineage(plan.select(F.col("source").alias("name"), "source_size", "target", "whole", "rest"))
    same = F.col("source").eqNullSafe(F.col("name"))
    asked = plan.where("rest > 0")
    # The order of documents inside a source is (place, doc_id); the bins are its leading bits.
    first = _reached(bins.join(asked, same), ["name"], "coarse", "rest").select("name", "source_size", F.col("coarse").alias("at"), (F.col("rest") - F.col("before")).alias("left"))
    inner = rows.join(first, same & (F.col("coarse") == F.col("at"))).groupBy("name", "at", "left", "fine").agg(F.sum("size").alias("words"))
    second = _reached(inner, ["name"], "fine", "left").select("name", "at", F.col("fine").alias("at_fine"), (F.col("left") - F.col("before")).alias("open"))
    edge = rows.where("size > 0").join(second, same & (F.col("coarse") == F.col("at")) & (F.col("fine") == F.col("at_fine")))
    order = Window.partitionBy("name").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("sum", F.sum("size").over(order))
    nearest = Window.partitionBy("name").orderBy(F.abs(F.col("sum") - F.col("open")), "place", "doc_id")
    last = edge.withColumn("rank", F.row_number().over(nearest)).where("rank = 1")
    # taken up to and with the last document, or up to just before the first one of the bin if that is nearer
    stop = last.select(
        F.col("name").alias("end_name"),
        F.when(F.col("open") <= F.abs(F.col("sum") - F.col("open")), F.shiftleft(F.shiftright("place", 36), 36) - 1).otherwise(F.col("place")).alias("end_place"),
        F.when(F.col("open") <= F.abs(F.col("sum") - F.col("open")), F.lit(None).cast("long")).otherwise(F.col("doc_id").cast("long")).alias("end_id"),
    )
    ends = cut_lineage(plan.join(stop, F.col("name").eqNullSafe(F.col("end_name")), "left"))
    out = rows.join(ends, same)
    more = (F.col("place") < F.col("end_place")) | ((F.col("place") == F.col("end_place")) & (F.col("end_id").isNull() | (F.col("doc_id") <= F.col("end_id"))))
    taken = F.col("size") * (F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "whole", taken.cast("long").alias("taken"))
