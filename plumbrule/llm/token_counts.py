"""Token counts of whole texts, with lengths only leaving the tokenizer.

A byte-level pre-tokenizer never joins a space to the characters before it, so the place between a visible
character and a following space is a safe boundary: the tokens of a text are those of its pieces.  Each task
cuts its texts there, encodes every new piece once, in batches of ``BATCH_BYTES``, and adds up the remembered
lengths.  The memory of pieces is bounded; a full one is emptied, which changes the cost and not the counts.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from plumbrule.llm.text import blocks, plain_strings

BATCH_BYTES = 1 << 20
MEMORY_PIECES = 1_000_000
MARKS = ".,;:!?"
#: A space behind anything that is no white space in any library's reading.
SAFE = re.compile(r"(?<=\S) ")
_ODD = re.compile(r"\s ")


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def pieces(text: str) -> tuple[str, list[str]]:
    """(first piece, the others without their leading space), cut at every safe boundary."""
    parts = SAFE.split(text) if _ODD.search(text) else text.split(" ")
    if len(parts) > 1 and not parts[0]:
        parts[0:2] = [" " + parts[1]]
    return parts[0], parts[1:]


def _encode(tokenizer, texts: list[str]) -> list[int]:
    """Lengths, from batches of about the same number of bytes."""
    out, batch, size = [], [], 0
    for text in texts:
        batch.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            out += [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
            batch, size = [], 0
    return out + [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


class PieceCounter:
    """Token numbers of pieces, each distinct piece encoded once while it is remembered.

    Marks behind a letter are counted apart from the word: no token of the pre-tokenizer joins them.
    """

    def __init__(self, path: str, room: int = MEMORY_PIECES) -> None:
        self.tokenizer, self.room, self.known, self.marks = _tokenizer(path), room, {}, {"": 0}

    def _core(self, piece: str) -> str:
        core = piece.rstrip(MARKS)
        return core if core[-1:].isalpha() and "<|" not in core else piece

    def _learn(self, texts: list[list[str]]) -> None:
        """Make the number of tokens of every piece known."""
        every = set().union(*texts)
        if len(self.known) + len(every) > self.room:
            self.known, self.marks = {}, {"": 0}
        cores = {p: self._core(p) for p in every - self.known.keys()}
        new = list(set(cores.values()) - self.known.keys())
        self.known.update(zip(new, _encode(self.tokenizer, [" " + c for c in new])))
        tails = list({p[len(c) :] for p, c in cores.items()} - self.marks.keys())
        self.marks.update(zip(tails, _encode(self.tokenizer, tails)))
        self.known.update({p: self.known[c] + self.marks[p[len(c) :]] for p, c in cores.items()})

    def count(self, texts: list[str]) -> np.ndarray:
        cut = [pieces(t) for t in texts]
        first = _encode(self.tokenizer, [p for p, _ in cut])
        self._learn([rest for _, rest in cut])
        return np.array([f + sum(map(self.known.__getitem__, rest)) for f, (_, rest) in zip(first, cut)], np.int64)


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> PieceCounter:
    """Kept by the Python worker from task to task."""
    return PieceCounter(path)


def token_count(column: Column, tokenizer_path: str) -> Column:
    """Number of tokens of each text, as the ``tokenizers`` library gives them without added tokens.

    The path must name a file that every executor has.  A null text has no tokens.  Strings of special tokens
    inside a text are handled as the library does by default.
    """

    @arrow_udf("long")
    def lengths(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(tokenizer_path)
        for texts in series:
            batch = pa.RecordBatch.from_arrays([plain_strings(texts)], names=["text"])
            counts = [counter.count(b.column(0).to_pylist()) for b in blocks(iter([batch]))]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))

    return lengths(column)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    Null and empty texts count 0 bytes and 0 tokens; repeated rows give repeated rows; other columns of the
    input, whatever their names, play no part; an empty table gives an empty result.
    """
    out = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = out.withColumn("n_tokens", token_count(F.col("text"), tokenizer_path))
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
