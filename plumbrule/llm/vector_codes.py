"""Short codes for vectors: product quantisation in whole numbers, the same on every machine.

Components become integers ``floor(scale * x)``, vectors are cut into equal parts, and every part position
learns a codebook by Lloyd rounds whose means are floored.  Squared distances come from exact dot products:
integers are broken into limbs so narrow that every float64 BLAS product stays below 2^53, and the products
of limbs are put together in int64.  Ties go to the lower index.

Defined cases: rows whose vector is NULL or holds NULL or non-finite components are left out.  The vector of
the smallest id (missing ids last, ties by components) sets the length; a length that the parts do not divide
is filled up with zeros.  Vectors of another length, or too large for exact int64 distances, stay in the
result with NULL code and error and teach nothing.  With fewer vectors than entries the codebooks are
shorter.  An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.llm.steps import settle

#: Bits of a limb.  A product of two limbs is below 2^24, so sums over 2^29 components stay exact in float64.
LIMB_BITS = 12
#: A label with more than this share of the rows gets its sum by broadcast: there are at most as many of them.
HEAVY_LABELS = 1000


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """``x`` as sum of ``limb[i] << (LIMB_BITS * i)``: all limbs but the last lie in [0, 2^LIMB_BITS)."""
    out = []
    while x.size and (x.max() >= 1 << LIMB_BITS or x.min() < -(1 << LIMB_BITS)):
        out.append((x & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        x = x >> LIMB_BITS
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices without rounding, by one float64 product per pair of limbs."""
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b)
    for i, x in enumerate(limbs(a)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << np.int64(LIMB_BITS * (i + j))
    return out


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, first on ties, and its squared distance) for every row."""
    gaps = (parts * parts).sum(axis=1)[:, None] - 2 * exact_products(parts, book) + (book * book).sum(axis=1)[None, :]
    best = gaps.argmin(axis=1)
    return best, gaps[np.arange(len(best)), best]


def largest_component(width: int) -> int:
    """Components up to this size have squared distances over ``width`` components below 2^62."""
    return int(2.0**30 / max(1, width) ** 0.5)


def integer_vectors(rows: DataFrame, vector: str, scale: int) -> tuple[Column, Column]:
    """(the row is kept, its components as integers; NULL where one is too large for a long)."""
    v = F.col(quoted(vector))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(v, lambda x: F.abs(x.cast("double")) * scale < 2.0**31 - 1)
    return v.isNotNull() & finite, F.when(small, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _matrix(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """rows x parts x components, zeros behind the last component."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    return np.pad(flat, ((0, 0), (0, -width % parts))).reshape(len(column), parts, -(-width // parts))


def _round_sums(vectors: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """parts x entries x (1 + components): members of every entry and their sums, added up by Spark."""
    parts, entries, size = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, 1 + size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _matrix(batch.column(0), width, parts)
            for p in range(parts):
                best, _ = nearest_entries(cut[:, p], books[p])
                order = np.argsort(best, kind="stable")
                members, at, n = np.unique(best[order], return_index=True, return_counts=True)
                sums[p, members, 0] += n
                sums[p, members, 1:] += np.add.reduceat(cut[order, p], at, axis=0)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.astype(np.int32)), "n": pa.array(sums.ravel()[cells])})

    out = np.zeros(books.size + parts * entries, np.int64)
    # the driver gets one number per component of the codebooks, however many rows there are
    for row in vectors.mapInArrow(partial, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(parts, entries, 1 + size)


def learn_codebooks(vectors: DataFrame, first: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """Lloyd rounds over all rows from the given parts x entries x components; unused entries stay."""
    books = first
    for _ in range(rounds):
        sums = _round_sums(vectors, books, width)
        used = sums[:, :, :1]
        books = np.where(used > 0, sums[:, :, 1:] // np.maximum(used, 1), books)
    return books


def _codes(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    parts = len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = _matrix(batch.column(batch.schema.get_field_index("v")), width, parts)
            code, error = np.zeros((len(cut), parts), np.uint8), np.zeros(len(cut), np.int64)
            for p in range(parts):
                best, gap = nearest_entries(cut[:, p], books[p])
                code[:, p] = best
                error += gap
            named = dict(zip(batch.schema.names, batch.columns))
            yield pa.RecordBatch.from_pydict({"id": named["id"], "label": named["label"], "code": pa.array([c.tobytes().hex() for c in code], pa.string()), "error": pa.array(error)})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("id", "label", "v").mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def _with_label_sums(rows: DataFrame) -> DataFrame:
    """Add the error summed over the rows of equal labels, missing labels together; missing errors add nothing.

    Sums are formed before anything is joined.  Labels that hold a thousandth of the rows or more are at most
    a thousand and reach the rows by broadcast; the rest meet in a shuffle in which no label is large.
    """
    rows = settle(rows)
    sums = settle(rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    heavy = F.col("_n") * HEAVY_LABELS >= total
    missing = sums.where(F.col("label").isNull()).select("label_error").first()
    large = sums.where(heavy & F.col("label").isNotNull()).select("label", F.col("label_error").alias("_large"))
    small = sums.where(~heavy & F.col("label").isNotNull()).select("label", F.col("label_error").alias("_small"))
    first = rows.join(F.broadcast(large), "label", "left")
    rest = first.where(F.col("_large").isNull() & F.col("label").isNotNull()).join(small, "label", "left").withColumn("label_error", F.col("_small"))
    none = F.lit(missing["label_error"] if missing else None).cast("long")
    done = first.where(F.col("_large").isNotNull() | F.col("label").isNull()).withColumn("label_error", F.when(F.col("label").isNull(), none).otherwise(F.col("_large")))
    return done.drop("_large").unionByName(rest.drop("_large", "_small"))


def compress_vectors(
    rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """(``id, label, code, error, label_error`` of all kept rows, codebooks as parts x entries x components)."""
    if not 0 < entries <= 256:
        raise ValueError("a code byte numbers 1 to 256 entries")
    keep, whole = integer_vectors(rows, vector, scale)
    kept = settle(rows.where(keep).select(F.col(quoted(key)).alias("id"), F.col(quoted(label)).alias("label"), whole.alias("v")))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    lead = kept.where(F.col("v").isNotNull()).orderBy(*order).select(F.size("v").alias("width")).first()
    width = lead["width"] if lead else 0
    limit = largest_component(width)
    fits = F.coalesce((F.size("v") == width) & F.forall("v", lambda x: (x <= limit) & (x >= -limit)), F.lit(False))
    usable = kept.where(fits)
    seeds = [r["v"] for r in usable.orderBy(*order).limit(entries).select("v").collect()]
    lost = kept.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not seeds:
        return _with_label_sums(lost), np.zeros((parts, 0, 0), np.int64)
    first = _matrix(pa.array(seeds, pa.list_(pa.int32())), width, parts).transpose(1, 0, 2)
    books = learn_codebooks(usable.select("v"), first, width, rounds)
    return _with_label_sums(_codes(usable, books, width).unionByName(lost)), books


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digest(rows: DataFrame, **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of all kept rows."""
    coded, books = compress_vectors(rows, **options)
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
