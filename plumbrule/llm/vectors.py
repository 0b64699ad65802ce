"""Hashed term vectors: counts per text, document frequencies of the whole table, weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.llm.text import blocks

#: Texts in one block of dense vectors.
ROWS = 256

Terms = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def count_matrix(owner: np.ndarray, term: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Dense counts of the terms of each row."""
    return np.bincount(owner * width + term, minlength=rows * width).reshape(rows, width).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of counts times idf, of length one; rows without terms stay zero."""
    out = np.sqrt(counts) * idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def document_frequencies(docs: DataFrame, terms: Terms, width: int, text: str = "text") -> tuple[int, np.ndarray]:
    """(rows with a term, in how many rows each term occurs), over the whole table.

    Every task sends one sum per term, whatever its number of rows; the driver gets ``width`` numbers.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width + 1, np.int64)
        for block in blocks(batches, rows=ROWS):
            owner, term = terms(block)
            present = np.bincount(owner * width + term, minlength=block.num_rows * width).reshape(-1, width) > 0
            seen[:width] += present.sum(axis=0)
            seen[width] += int(present.any(axis=1).sum())
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"term": pa.array(full.astype(np.int32)), "n": pa.array(seen[full])})

    sums = docs.select(F.col(text).alias("text")).mapInArrow(partial, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(width + 1, np.int64)
    for row in sums:
        out[row["term"]] = row["n"]
    return int(out[width]), out[:width]


def inverse_frequencies(rows: int, seen: np.ndarray) -> np.ndarray:
    return (np.log((1.0 + rows) / (1.0 + seen)) + 1.0).astype(np.float32)


def crc_remainder(key: Column, parts: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)).cast("int")


def bounded_sample(rows: DataFrame, group: str, key: str, most: int, seed: int = 5) -> DataFrame:
    """At most ``most`` rows of each group, those with the smallest hashes of their keys.

    The rows are thinned by a hash threshold first, so that no group is sorted whole.
    """
    from pyspark.sql import Window

    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = rows.withColumn("_place", place).join(F.broadcast(counts), group).where(F.col("_place") * F.col("_n") < 1.5 * most + 50)
    order = Window.partitionBy(group).orderBy("_place", key)
    return thin.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_place", "_n", "_rank")
