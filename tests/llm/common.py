"""Small inputs and brute-force versions for the tests of the corpus operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns whose names occur inside the operators.
CLASHING = [("label", T.StringType()), ("node", T.LongType()), ("mark", T.StringType()), ("spans", T.StringType()), ("score", T.DoubleType()), ("key", T.StringType()), ("row", T.StringType()), ("place", T.LongType())]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, t) for n, t in CLASHING]
)


def documents(spark, rows):
    """``rows``: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "x", 1, "m", "sp", 0.5, "k", "r", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    known = ["".join(random.Random(i).choice(("an", "er", "th", "is", "on", "re", "st", "en", "lo", "ka")) for _ in range(random.Random(-i).randint(1, 4))) for i in range(vocabulary)]
    out = []
    while len(out) < words:
        sentence = [rng.choice(known) for _ in range(rng.randint(4, 14))]
        out += [sentence[0].capitalize(), *sentence[1:-1], sentence[-1] + "."]
    return " ".join(out[:words])


def edge_rows():
    """Null, empty, blank, marks only, one word, very long, tied, repeated rows, and a missing id."""
    long = prose(1, 30_000)
    return [
        (1, None, None, None), (2, "", "en", None), (3, " \t\n\r\x0b\x0c ", "en", "s"), (4, "?!### ...", "de", "s"), (5, "word", "en", "s"), (6, long, "en", "s"),
        (7, prose(2, 80), "en", "t"), (8, prose(2, 80), "en", "t"), (8, prose(2, 80), "en", "t"), (9, prose(2, 80), None, "t"), (10, "naïve 𝒳𝒴 😀 " * 30, "fr", "u"), (10, prose(3, 60), "fr", "u"), (11, "a\u0000b c " + prose(4, 40), "en", "u"),
    ]


def edge_documents(spark):
    return documents(spark, edge_rows())


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = TOKEN.findall((text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))
