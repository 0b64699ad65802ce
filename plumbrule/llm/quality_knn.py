"""Text quality by votes of the nearest labelled texts in a latent-semantic space.

Terms describe how a text is written: n-grams of its character classes (letters of either case, digits, white
space, every ASCII mark as itself) and, for every word, how long ago the same word came last.  Their weighted
counts are projected on the leading directions of the labelled texts.  Every text is compared with all
labelled vectors, in blocks, and the nearest ones vote with their similarities.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbrule.llm.text import blocks, byte_class, mix, plain_strings, raw_bytes, runs, span_hashes
from plumbrule.llm.vectors import ROWS, bounded_sample, count_matrix, document_frequencies, inverse_frequencies, weighted

SHAPES = 1000
WIDTH = 1024
#: Labelled rows that are broadcast, of each label.
PER_LABEL = 3000
DIMENSIONS = 40
NEIGHBOURS = 15
_WORD = ~byte_class(" \t\n\x0b\x0c\r", False)


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class number of each byte: marks stay apart, letters of a case, digits and white space fall together."""
    out = np.arange(256, dtype=np.uint64)
    out[byte_class("abcdefghijklmnopqrstuvwxyz", True)] = ord("a")
    out[byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ", False)] = ord("A")
    out[byte_class("0123456789", False)] = ord("0")
    return out


def _distance_terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One term per word: the binary order of the number of words since the same word in the same text."""
    starts, ends = runs(_WORD[buf], offsets)
    counts = np.diff(np.searchsorted(starts, offsets))
    owner = np.repeat(np.arange(len(counts)), counts)
    key = mix(span_hashes(buf, starts, ends) + owner.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    gap = np.zeros(len(key), np.int64)
    gap[order[1:]] = np.diff(order)
    far = np.full(len(key), 23)
    back = np.zeros(len(key), bool)
    back[order] = again
    far[back] = np.minimum(np.log2(np.maximum(gap[back], 1)).astype(np.int64), 22)
    return owner, SHAPES + far


def style_terms(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of the class n-grams, runs of one class cut to three, and of the word distances."""
    buf, offsets = raw_bytes(plain_strings(block.column(block.schema.get_field_index("text"))))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    shape = _classes()[buf]
    keep = np.ones(len(shape), bool)
    keep[3:] = ~((shape[3:] == shape[2:-1]) & (shape[2:-1] == shape[1:-2]) & (shape[1:-2] == shape[:-3]) & (owner[3:] == owner[:-3]))
    shape, owner = shape[keep], owner[keep]
    rows, terms = [], []
    for n in (1, 2, 3):
        if len(shape) < n:
            break
        code = np.full(len(shape) - n + 1, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(257) + shape[i : len(shape) - n + 1 + i]
        same = owner[: len(code)] == owner[n - 1 :]
        rows.append(owner[: len(code)][same])
        terms.append((mix(code[same]) % np.uint64(SHAPES)).astype(np.int64))
    far = _distance_terms(buf, offsets)
    return np.concatenate([*rows, far[0]]), np.concatenate([*terms, far[1]])


@dataclass(frozen=True)
class QualityModel:
    """Of fixed size: directions, and at most ``PER_LABEL`` vectors of each label."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    weights: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> QualityModel:
    """Frequencies from all ``docs`` (``doc_id, text``); directions and vectors from a sample of the labelled ones.

    The sample is drawn from ids alone, and at most ``PER_LABEL`` ids of each label are then sent to the texts.
    """
    idf = inverse_frequencies(*document_frequencies(docs, style_terms, WIDTH))
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL").distinct()
    ids = docs.where(~held_out & F.col("text").isNotNull()).select("doc_id").distinct()
    labelled = ids.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, rows=ROWS):
            x = weighted(count_matrix(*style_terms(block), block.num_rows, WIDTH), shared.value).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*block.select(["doc_id", "quality"]).columns, pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    drawn = bounded_sample(labelled, "quality", "doc_id", PER_LABEL)
    sample = docs.where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")
    schema = StructType([sample.schema["doc_id"], sample.schema["quality"]]).add("x", "binary")
    found = sorted(sample.mapInArrow(vectors, schema).collect(), key=lambda r: (r["quality"], r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float32).reshape(-1, WIDTH)
    labels = np.array([r["quality"] for r in found], np.float32)
    _, directions = np.linalg.eigh(x.T @ x) if len(x) else (None, np.zeros((WIDTH, 0), np.float32))
    directions = directions[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    # each label's sample stands for all its rows
    kept = {q: max(1, int((labels == q).sum())) for q in counts}
    weights = np.array([counts[q] / kept[q] for q in labels.tolist()], np.float32)
    total = sum(counts.values())
    prior = float(sum(n for q, n in counts.items() if q) / total) if total else 0.5
    return QualityModel(idf, directions, _unit(x @ directions), labels, prior, weights / weights.max() if len(weights) else weights)


def _vote(cosine: np.ndarray, m: QualityModel) -> np.ndarray:
    k = min(NEIGHBOURS, cosine.shape[1])
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    similar = np.take_along_axis(cosine, near, axis=1)
    # a neighbour counts by how near it is beside the nearest one
    apart = 1.0 - similar
    weight = m.weights[near] / (apart + 0.1 * apart.min(axis=1, keepdims=True) + 1e-4)
    return (weight * m.labels[near]).sum(axis=1) / weight.sum(axis=1)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Add ``score`` to every row: the share of label 1 among the votes of the nearest labelled texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in blocks(batches, column=text, rows=ROWS):
            own = pa.RecordBatch.from_arrays([block.column(names.index(text))], names=["text"])
            x = weighted(count_matrix(*style_terms(own), block.num_rows, WIDTH), m.idf)
            out = np.full(block.num_rows, m.prior)
            full = x.any(axis=1)
            if len(m.labels) and full.any():
                out[full] = _vote(_unit(x[full] @ m.directions) @ m.vectors.T, m)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(np.clip(out, 0.0, 1.0))], names=[*names, "score"])

    return docs.mapInArrow(votes, StructType(list(docs.schema.fields)).add("score", "double"))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``held_out`` is a condition on ``doc_id``.

    NULL and empty texts get the share of label 1 among the labelled rows, and 0.5 if there are none, as does
    every text then.  Rows of ``labels`` with a NULL quality teach nothing; repeated documents give repeated
    rows; other columns of either table play no part.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    model = fit(rows, labels, held_out)
    scored = score(rows.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
