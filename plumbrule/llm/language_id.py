"""Language identification by the nearest of several clustered centroids per language.

A text is the vector of its letter n-grams (one to three code points, hashed), weighted by inverse document
frequencies over all training rows.  The vectors of a bounded sample of each language are clustered on the
sphere; a text gets the language of the nearest centroid by cosine, and is marked as rejected when it lies
farther away than nearly all training texts of that cluster.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbrule.llm.text import blocks, mix, plain_strings
from plumbrule.llm.vectors import ROWS, bounded_sample, count_matrix, document_frequencies, inverse_frequencies, weighted

WIDTH = 4096
#: Rows of each language that the centroids are fitted on.
PER_LANGUAGE = 400
CENTROIDS = 6
ROUNDS = 12
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_terms(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every letter n-gram; a run of other characters is one space."""
    column = plain_strings(block.column(block.schema.get_field_index("text")), lower=True)
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    letter = _letters()[points]
    before = np.concatenate([[False], letter[:-1]])
    first = np.cumsum(sizes) - sizes
    before[first[first < len(before)]] = False
    keep = letter | before
    points, owner = np.where(letter, points, np.uint32(32))[keep].astype(np.uint64), owner[keep]
    rows, terms = [], []
    code = np.zeros(len(points), np.uint64)
    for n in range(1, 4):
        code = code[: len(points) - n + 1] * np.uint64(0x110001) + points[n - 1 :] if len(points) >= n else code[:0]
        same = owner[: len(code)] == owner[n - 1 :] if len(code) else np.zeros(0, bool)
        rows.append(owner[: len(code)][same])
        terms.append((mix(code[same] + np.uint64(n << 62 & (1 << 63) - 1)) % np.uint64(WIDTH)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(terms)


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, own centroid of each row) of spherical k-means, started from the farthest rows."""
    centres = vectors[:1]
    best = vectors @ centres[0]
    while len(centres) < min(k, len(vectors)):
        far = int(np.argmin(best))
        centres = np.vstack([centres, vectors[far : far + 1]])
        best = np.maximum(best, vectors @ vectors[far])
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres).astype(np.float32)
    return centres, np.argmax(vectors @ centres.T, axis=1)


@dataclass(frozen=True)
class LanguageModel:
    """Small whatever the table: it grows only with the number of languages."""

    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    language_of: np.ndarray
    nearest_allowed: np.ndarray


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", tail: float = 0.002) -> LanguageModel:
    """Learn from the rows with a language and a text.

    Frequencies count all these rows; centroids and rejection distances come from ``PER_LANGUAGE`` rows of each language.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    idf = inverse_frequencies(*document_frequencies(rows, letter_terms, WIDTH))
    shared_idf = docs.sparkSession.sparkContext.broadcast(idf)

    out = pa.schema([("lang", pa.string()), ("centre", pa.binary()), ("allowed", pa.float64())])

    def centroids(group: pa.Table) -> pa.Table:
        parts = [weighted(count_matrix(*letter_terms(b), b.num_rows, WIDTH), shared_idf.value) for b in blocks(iter(group.to_batches()), rows=ROWS)]
        vectors = np.vstack(parts)
        vectors = vectors[vectors.any(axis=1)]
        if not len(vectors):
            return out.empty_table()
        centres, own = cluster(vectors, CENTROIDS)
        allowed = float(np.quantile((vectors * centres[own]).sum(axis=1), tail))
        lang = group.column("lang")[0].as_py()
        return pa.Table.from_pylist([{"lang": lang, "centre": centres[c].astype(np.float32).tobytes(), "allowed": allowed} for c in sorted(set(own.tolist()))], out)

    sample = bounded_sample(rows, "lang", "doc_id", PER_LANGUAGE)
    found = sample.groupBy("lang").applyInArrow(centroids, "lang string, centre binary, allowed double").collect()
    found.sort(key=lambda r: (r["lang"], r["centre"]))
    languages = sorted({r["lang"] for r in found})
    number = {name: i for i, name in enumerate(languages)}
    return LanguageModel(
        languages,
        idf,
        np.array([np.frombuffer(r["centre"], np.float32) for r in found]).reshape(-1, WIDTH),
        np.array([number[r["lang"]] for r in found], int),
        np.array([r["allowed"] for r in found]),
    )


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred, score, rejected``: nearest language, its cosine, and whether the text lies too far from it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names = docs.columns

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for block in blocks(batches, column=text, rows=ROWS):
            at = names.index(text)
            owner, term = letter_terms(pa.RecordBatch.from_arrays([block.column(at)], names=["text"]))
            has_letter = np.bincount(owner, minlength=block.num_rows) > 0
            if len(m.languages):
                cosine = weighted(count_matrix(owner, term, block.num_rows, WIDTH), m.idf) @ m.centres.T
                best = np.argmax(cosine, axis=1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0.0, 1.0)
                lang = [m.languages[m.language_of[b]] if ok else UNKNOWN for b, ok in zip(best, has_letter)]
                rejected = ~has_letter | (score < m.nearest_allowed[best])
            else:
                lang, score, rejected = [UNKNOWN] * block.num_rows, np.zeros(block.num_rows), np.ones(block.num_rows, bool)
            columns = [*block.columns, pa.array(lang, pa.string()), pa.array(np.where(has_letter, score, 0.0)), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(near, schema)


def identify_languages(docs: DataFrame, held_out: Column, lang: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row, learned from the rows that are not held out.

    Texts that are NULL or have no letter get ``und`` with score 0 and are rejected; so does every text when
    nothing can be learned.  Rows without a language are predicted like all others.  Ties between centroids go
    to the language that comes first; repeated rows give repeated rows; other columns play no part.
    """
    rows = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    model = fit(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
