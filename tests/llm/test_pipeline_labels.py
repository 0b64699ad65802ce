"""The quality stage of the pipeline with labels that teach little or nothing."""

import corpus_pipeline
from tests.llm.common import documents, prose


def kept(spark, folder, labels):
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    rows = [(i, prose(i, 40)) for i in range(1, 13)] + [(20, None), (21, "")]
    out = corpus_pipeline.drop_low_quality(spark, documents(spark, rows), str(folder))
    return {r["doc_id"] for r in out.collect()}


def test_all_stay_without_usable_labels(spark, tmp_path):
    assert kept(spark, tmp_path, [(1, None), (999, 1)]) == {*range(1, 13), 20, 21}


def test_empty_texts_stay_when_most_labels_are_low(spark, tmp_path):
    assert {20, 21} <= kept(spark, tmp_path, [(i, 0) for i in range(1, 13)])
