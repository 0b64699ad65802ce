"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbrule.llm import (
    decontaminate, forest_join, language_id, paragraph_dedup, quality_knn, robust_outliers, source_mix, suffix_dedup, token_counts, warc_bundles,
)
from tests.llm.common import documents, edge_documents, edge_rows, prose


def labels(spark):
    return spark.createDataFrame([(6, 1), (7, 0), (9, 1), (10, None)], "doc_id long, quality int")


def items(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "tiny", "x"), (4, prose(2, 80)[30:230], "x")], "item_id long, text string, key string")


PER_ROW = {
    "paragraphs": lambda s, d: paragraph_dedup.removal_summary(paragraph_dedup.dedup_paragraphs(d)),
    "join": lambda s, d: forest_join.join_texts(d),
    "language": lambda s, d: language_id.identify_languages(d, F.col("doc_id") == 9),
    "mix": lambda s, d: source_mix.mix_sources(d),
    "suffix": lambda s, d: paragraph_dedup.removal_summary(suffix_dedup.dedup_substrings(d)),
    "outliers": lambda s, d: robust_outliers.robust_quality(d),
    "tokens": lambda s, d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "quality": lambda s, d: quality_knn.score_quality(d, labels(s), F.col("doc_id") == 9),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_per_document(spark, name):
    rows = PER_ROW[name](spark, edge_documents(spark)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in edge_rows())


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(spark, name):
    assert PER_ROW[name](spark, edge_documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["paragraphs", "join", "mix", "suffix", "quality", "language"])
def test_rows_without_id(spark, name):
    rows = PER_ROW[name](spark, documents(spark, [(None, prose(5, 90)), (3, prose(5, 90)), (4, prose(6, 90))])).collect()
    assert len(rows) == 3


def test_items_in_edge_documents(spark):
    found = decontaminate.find_items(edge_documents(spark), items(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(7, 4), (8, 4), (9, 4)}
    assert decontaminate.find_items(edge_documents(spark).limit(0), items(spark)).collect() == []
    assert decontaminate.find_items(edge_documents(spark), items(spark).limit(0)).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a\nb", "same", "x"), (2, None, "same", "x"), (2, None, "same", "x"), (3, "u", None, "x"), (4, "u", "", "x"), (5, "u", "größe " * 60_000, "x"), (6, "u", "WARC/1.1\r\n\r\n", "x")],
        "page_id long, url string, html string, sha string",
    )
    rows = warc_bundles.archive_pages(pages).collect()
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows)
    assert got == [(1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 480_000, "response", None), (6, 12, "response", None)]
    assert warc_bundles.archive_pages(pages.limit(0)).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    items(spark).write.parquet(f"{path}/benchmark.parquet")
    labels(spark).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, folder, stage, empty):
    docs = edge_documents(spark).limit(0) if empty else edge_documents(spark)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    more = ["mix_target", "mix_copies"] if stage == "source_mix" else []
    assert out.columns == docs.columns + more
    rows = out.collect()
    assert not rows if empty else {r["doc_id"] for r in rows} <= {r[0] for r in edge_rows()}
