"""From raw documents to a weighted training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that it gets; its result is written and read
again before the next one.  Rows with the same ``doc_id`` and text count as one document.  Columns besides
``doc_id, text, source, n_chars`` are carried along whatever their names; NULL and empty texts are defined in
the operators that the stages call.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbrule.core.session import cut_lineage
from plumbrule.llm import decontaminate, forest_join, quality_knn, source_mix, suffix_dedup
from plumbrule.llm.paragraph_dedup import without_spans
from plumbrule.llm.vectors import crc_remainder
from plumbrule.plans.registry import table


def _wrapped(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, text`` beside the rest of the row, so that other columns cannot clash with new ones."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))


def _unwrapped(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` from wrapped rows, some of them replaced."""
    own = {"text": F.col("text")} | new
    return rows.select(*[own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns])


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    """Documents whose nearest labelled texts are mostly of low quality go.

    Texts without a character to judge stay, and all texts if no label can be used.
    """
    rows = _wrapped(docs)
    model = quality_knn.fit(rows.select("doc_id", "text"), table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 4) == 2)
    if not len(model.labels):
        return docs
    empty = F.coalesce(F.octet_length("text"), F.lit(0)) == 0
    return _unwrapped(quality_knn.score(rows.select("text", "row"), model).where(empty | (F.col("score") >= threshold)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents the one with the smallest id stays."""
    rows = _wrapped(docs).withColumn("id", F.struct("doc_id", "mark"))
    classes = forest_join.join_texts(rows.select("id", "text"), key="id")
    first = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("id")).distinct()
    return _unwrapped(rows.join(first, "id", "left_semi").dropDuplicates(["id"]), docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes or more that an earlier document has are cut out; bytes left of a cut character go as well.

    ``n_chars`` is counted anew where a text changes, and documents that lose all their text go.
    """
    rows = _wrapped(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = without_spans(rows, suffix_dedup.repeated_spans(rows.select("doc_id", "mark", "text")))
    changed = F.size("spans") > 0
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept_text").cast("string")), "�", "")
    new = {"text": F.when(changed, left).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(left)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return _unwrapped(out.where(~changed | (F.octet_length("kept_text") > 0)), docs, **new)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or with few edits, go; another text under the same id stays."""
    key, mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")
    found = decontaminate.find_items(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), by_text=True)
    hits = found.select(F.col("doc_id").alias("_hit"), F.col("mark").alias("_mark")).distinct()
    return docs.join(hits, (key == F.col("_hit")) & (mark == F.col("_mark")), "left_anti")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``mix_target`` of their source and ``mix_copies``, how often each is taken."""
    taken = source_mix.mix_sources(docs.select("doc_id", "text", "source"))
    copies = taken.where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("target").alias("mix_target"), (F.col("taken") / F.col("size")).cast("int").alias("mix_copies")
    )
    copies = copies.dropDuplicates(["_id", "_source"])
    named = docs.drop("mix_target", "mix_copies")
    return named.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))).where(source_mix.word_count(F.col("text")) > 0).drop("_id", "_source")


STAGES = [
    ("quality_knn", drop_low_quality),
    ("forest_join", drop_near_copies),
    ("suffix_dedup", cut_repeated_strings),
    ("decontaminate", drop_contaminated),
    ("source_mix", mix_to_weights),
]

#: Votes of neighbours, adaptive forests and string repeats have no SQL of bearable cost; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
