"""Texts are judged by themselves: not by their neighbours in a batch, nor by another text under the same id."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from plumbrule.llm import decontaminate, language_id, lm_scoring, quality_knn
from plumbrule.llm.text import plain_strings, raw_bytes, shingle_hashes, tokens
from tests.llm.common import documents, prose

TEXTS = ["?! Über 3 mots.", "5 a b c d e f", "", "...", "ünd so", "word", None, " x", "日本語のテキスト", "a" * 70]
NEIGHBOURS = ["", "z", "end.", "5", "é", "漢", " ", "-"]


def _batch(*texts):
    return pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})


def _of_last(pairs):
    owner, term = pairs
    return sorted(term[owner == 1].tolist())


def _word_hashes(batch):
    buf, offsets = raw_bytes(plain_strings(batch.column(0), lower=True))
    _, _, hashes, counts = tokens(buf, offsets)
    found, sizes = shingle_hashes(hashes, counts, 5)
    return np.repeat(np.arange(len(sizes)), sizes), found


def _lm_tokens(batch):
    found, sizes = lm_scoring.text_tokens(batch)
    left = lm_scoring.left_tokens(found, sizes)
    return np.repeat(np.arange(len(sizes)), sizes), lm_scoring.pair_keys(left, found)


def _windows(batch):
    buf, offsets = decontaminate.plain_bytes(batch.column(0))
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), buf.astype(np.int64)


KERNELS = {"language": language_id.letter_terms, "quality": quality_knn.style_terms, "shingles": _word_hashes, "model": _lm_tokens, "items": _windows}


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_terms_do_not_depend_on_neighbours(name):
    for text in TEXTS:
        alone = _of_last(KERNELS[name](_batch("", text)))
        for other in NEIGHBOURS:
            assert _of_last(KERNELS[name](_batch(other, text))) == alone, (other, text)


def test_contaminated_text_does_not_take_another_of_its_id(spark, tmp_path):
    item = prose(11, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [(1, prose(2, 30) + " " + item), (1, prose(3, 60)), (2, prose(4, 60)), (None, item + " " + prose(5, 20)), (None, prose(6, 50))])
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("1", prose(3, 60)), ("2", prose(4, 60)), ("None", prose(6, 50))]
