"""Removal of paragraphs and passages that occur, exactly or nearly, in an earlier document.

A line is a paragraph; a long line is cut on at sentence ends that its own words choose, so a passage is cut
alike wherever it stands.  Neighbouring pieces that are too short to be compared make one paragraph.  Paragraphs with the same words are one node; different ones meet by MinHash bands,
are compared exactly, and form components.  The first paragraph of each component stays.

What is left is compared in windows of ``MIN_WORDS`` words that lie anywhere, across lines and sentences.  Of
every ``WINNOW`` windows in a row the one with the smallest hash is taken (winnowing), so equal passages of
``MIN_WORDS + WINNOW - 1`` words always share one, and all their words but ``WINNOW - 1`` at each end lie in
shared ones.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from plumbrule.llm.minhash import LEAST, SIZE, compare_buckets, crowded, label_components, needed_trees, prefix_keys, shingle_sets, signatures
from plumbrule.llm.steps import settle
from plumbrule.llm.text import blocks, byte_class, digests, grouped, mix, packed, plain_strings, raw_bytes, shingle_hashes, tokens

MIN_WORDS = 15
#: One sentence end in so many also ends the paragraph.
SENTENCES = 4
#: Of so many windows in a row at least one is compared.
WINNOW = 10
ROWS_PER_BAND = 2
RECALL = 0.995
_ENDS = byte_class(".!?", False)
_SPACE = byte_class(" \t\r\n", False)


@functools.lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def paragraphs(column: pa.Array, least_words: int = MIN_WORDS):
    """(text number, first byte in the text, end, number of words, hashes of all these words) of every paragraph.

    The paragraphs of a text cover all its bytes; white space and marks belong to the paragraph before them.
    """
    buf, offsets = raw_bytes(plain_strings(column))
    low = _lower()[buf]
    starts, ends, words, counts = tokens(low, offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    line = np.concatenate([[0], np.cumsum(buf == 10)])
    stop = np.zeros(len(buf), bool)
    stop[:-1] = _ENDS[buf[:-1]] & _SPACE[buf[1:]]
    stops = np.concatenate([[0], np.cumsum(stop)])
    first = np.ones(len(words), bool)
    if len(words) > 1:
        gap = lambda total: total[starts[1:]] > total[ends[:-1]]
        first[1:] = (owner[1:] != owner[:-1]) | gap(line) | (gap(stops) & (words[:-1] % np.uint64(SENTENCES) == 0))
    head = np.flatnonzero(first)
    sizes = np.diff(np.concatenate([head, [len(words)]]))
    short = sizes < least_words
    joined = np.zeros(len(head), bool)
    joined[1:] = short[1:] & short[:-1] & (owner[head[1:]] == owner[head[:-1]])
    head = head[~joined]
    sizes = np.diff(np.concatenate([head, [len(words)]]))
    text = owner[head]
    begin = starts[head] - offsets[text]
    begin[np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]] = 0
    end = np.concatenate([begin[1:], [0]])[: len(begin)]
    last = np.concatenate([text[1:] != text[:-1], [True]])[-len(text) :] if len(text) else np.zeros(0, bool)
    end[last] = np.diff(offsets)[text[last]]
    return text, begin, end, sizes, words


def _long_enough(column: pa.Array, least_words: int):
    """The paragraphs that are long enough to be compared, with their words."""
    text, begin, end, sizes, words = paragraphs(column, least_words)
    keep = sizes >= least_words
    return text[keep], begin[keep], end[keep], sizes[keep], words[np.repeat(keep, sizes)]


def _sign(bands: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            text, begin, end, sizes, words = _long_enough(block.column(2), least_words)
            shingles, n = shingle_hashes(words, sizes, SIZE)
            keys = prefix_keys(signatures(shingles, n, bands * ROWS_PER_BAND), bands, ROWS_PER_BAND)
            own = pa.array(text)
            columns = [block.column(0).take(own), block.column(1).take(own), pa.array(begin), pa.array(end), pa.array(digests(words, sizes), pa.binary()), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(keys[:, i]) for i in range(bands)]], names=["doc_id", "mark", "begin", "end", "node", "n_shingles", *[f"k{i}" for i in range(bands)]])

    return run


def _sets(least_words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sets = [], []
        for block in blocks(iter([batch])):
            _, _, _, sizes, words = _long_enough(block.column(block.schema.get_field_index("text")), least_words)
            shingles, n = shingle_hashes(words, sizes, SIZE)
            nodes += digests(words, sizes)
            ends = np.cumsum(n)
            sets += [np.unique(shingles[b - k : b]) for b, k in zip(ends, n)]
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), packed(flat, np.array([len(s) for s in sets], np.int64))], names=["node", "shingles"])

    return run


def repeated_paragraphs(docs: DataFrame, *, least: float = LEAST, least_words: int = MIN_WORDS, recall: float = RECALL) -> DataFrame:
    """``doc_id, mark, begin, end, label, kept, kept_in`` of every paragraph that has a copy or near copy.

    ``docs`` has ``doc_id, mark, text``; ``mark`` tells texts with the same id apart.
    """
    docs = docs.where("doc_id IS NOT NULL")
    bands = needed_trees(ROWS_PER_BAND, least, recall)
    names = [f"k{i}" for i in range(bands)]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, mark long, begin long, end long, node binary, n_shingles long, " + ", ".join(f"{k} long" for k in names)
    every = settle(docs.select("doc_id", "mark", "text").mapInArrow(_sign(bands, least_words), schema))
    # keys of equal words are equal, so any aggregate gives them; this one is combined before the shuffle
    distinct = every.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), *[F.min(k).alias(k) for k in names])
    distinct = settle(distinct.select("node", "doc_id", "copies", "n_shingles", F.array(*names).alias("keys")))
    slots = distinct.select("node", F.posexplode("keys").alias("tree", "key"))
    crowd = slots.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = settle(slots.join(crowd.hint("merge"), ["tree", "key"], "left_semi").select("node").distinct())
    met = settle(distinct.join(met.hint("merge"), "node", "left_semi"))
    nodes = settle(met.join(shingle_sets(docs.select("doc_id", "text"), met.select("doc_id", "node"), _sets(least_words)), "node"))
    known = [("keys", True)]
    if nodes.isEmpty():
        labels = distinct.select("node", F.col("node").alias("label")).limit(0)
    else:
        found = settle(compare_buckets(nodes, "keys", crowded(nodes, "keys", known), least, known))
        labels = label_components(nodes.select("node"), found)
    linked = distinct.join(labels, "node", "left").where("copies > 1 OR label IS NOT NULL").select("node", F.coalesce("label", "node").alias("label"))
    spots = settle(every.select("doc_id", "mark", "begin", "end", "node").join(linked.hint("merge"), "node").drop("node"))
    firsts = spots.groupBy("label").agg(F.min(F.struct("doc_id", "begin", "mark")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("begin") == F.col("first.begin")) & (F.col("mark") == F.col("first.mark"))
    return spots.join(firsts.hint("merge"), "label").select("doc_id", "mark", "begin", "end", "label", same.alias("kept"), F.col("first.doc_id").alias("kept_in"))


def chosen_windows(hashes: np.ndarray, counts: np.ndarray, winnow: int = WINNOW) -> np.ndarray:
    """Numbers of the hashes that are the smallest, and of equal ones the last, of ``winnow`` neighbours in their text.

    A text with fewer hashes has its smallest.
    """
    chosen = np.zeros(len(hashes), bool)
    if len(hashes) >= winnow:
        width = len(hashes) - winnow + 1
        best, place = hashes[:width].copy(), np.arange(width)
        for j in range(1, winnow):
            own = hashes[j : j + width]
            lower = own <= best
            best[lower] = own[lower]
            place[lower] = np.flatnonzero(lower) + j
        owner = np.repeat(np.arange(len(counts)), counts)
        chosen[place[owner[:width] == owner[winnow - 1 :]]] = True
    few = np.repeat(counts < winnow, counts)
    chosen |= few & (hashes == np.repeat(grouped(np.minimum, hashes, counts, np.uint64(0)), counts))
    return np.flatnonzero(chosen)


def _windows(column: pa.Array, least_words: int):
    """(text number, first byte in the text, end, hash, second hash) of every chosen window of ``least_words`` words."""
    buf, offsets = raw_bytes(plain_strings(column))
    starts, ends, words, counts = tokens(_lower()[buf], offsets)
    counts = np.where(counts >= least_words, counts, 0)
    enough = np.repeat(counts > 0, np.diff(np.searchsorted(starts, offsets)))
    starts, ends, words = starts[enough], ends[enough], words[enough]
    hashes, n = shingle_hashes(words, counts, least_words)
    first = np.arange(len(hashes)) + np.repeat((np.cumsum(counts) - counts) - (np.cumsum(n) - n), n)
    at = chosen_windows(hashes, n)
    text, first = np.repeat(np.arange(len(n)), n)[at], first[at]
    check = np.zeros(len(at), np.uint64)
    for i in range(least_words):
        check = mix(check + words[first + i])
    return text, starts[first] - offsets[text], ends[first + least_words - 1] - offsets[text], hashes[at].view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _hash_windows(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_windows(block.column(0), least_words)[3])], names=["window"])

    return run


def _place_windows(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            text, begin, end, window, check = _windows(block.column(2), least_words)
            own = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(own), block.column(1).take(own), *map(pa.array, (begin, end, window, check))], names=["doc_id", "mark", "begin", "end", "window", "check"]
            )

    return run


def repeated_passages(docs: DataFrame, gone: DataFrame, *, least_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, mark, begin, end, kept_in`` of every chosen window that an earlier document has.

    ``docs`` has ``doc_id, mark, text``; windows that touch a span of ``gone`` (``doc_id, mark, begin, end``) are
    left out, so a document never loses words for the sake of a place that is removed itself.
    """
    docs = docs.where("doc_id IS NOT NULL")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # only hashes are counted at first; the places of those that occur once are dropped before they are grouped
    hashes = docs.select("text").mapInArrow(_hash_windows(least_words), "window long")
    several = settle(hashes.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"))
    places = docs.select("doc_id", "mark", "text").mapInArrow(_place_windows(least_words), f"doc_id {id_type}, mark long, begin long, end long, window long, check int")
    places = places.join(several.hint("merge"), "window", "left_semi")
    lists = gone.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("begin", "end")).alias("gone"))
    touched = F.exists("gone", lambda s: (s["begin"] < F.col("end")) & (s["end"] > F.col("begin")))
    left = settle(places.join(lists.hint("merge"), ["doc_id", "mark"], "left").where(~F.coalesce(touched, F.lit(False))).drop("gone"))
    own = F.struct("doc_id", "mark")
    firsts = left.groupBy("window", "check").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first != last").drop("last")
    return left.join(firsts.hint("merge"), ["window", "check"]).where(own != F.col("first")).select("doc_id", "mark", "begin", "end", F.col("first.doc_id").alias("kept_in"))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = ArrayType(StructType().add("begin", "long").add("end", "long"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Add ``kept_text`` (bytes) and ``spans`` (array of begin, end) to ``docs`` (``doc_id, mark, text, ...``).

    ``spans`` has ``doc_id, mark, begin, end``: bytes to remove from each text.
    """
    lists = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("begin", "end")).alias("_spans"))
    both = docs.join(lists.hint("merge"), ["doc_id", "mark"], "left")  # lists grow with the input
    names = [c for c in both.columns if c != "_spans"]
    schema = StructType([both.schema[c] for c in names]).add("kept_text", "binary").add("spans", _SPANS)
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = block.column(block.schema.get_field_index("text")).to_pylist()
            kept, cuts = [], []
            for text, found in zip(texts, block.column(block.schema.get_field_index("_spans")).to_pylist()):
                raw, at, parts = (text or "").encode(), 0, []
                runs = merged_spans([(s["begin"], s["end"]) for s in found or ()])
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                kept.append(b"".join([*parts, raw[at:]]))
                cuts.append([{"begin": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([*[block.column(block.schema.get_field_index(c)) for c in names], pa.array(kept, pa.binary()), pa.array(cuts, span_type)], names=[*names, "kept_text", "spans"])

    return both.mapInArrow(run, schema)


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, text``, where ``mark`` tells different texts with the same id apart."""
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def dedup_paragraphs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, text, kept_text, spans, kept_in`` of every row.

    A paragraph with at least ``least_words`` words goes if an earlier one, in the order of ``doc_id`` and
    place, is equal or at least ``least`` similar to it or to another of its component; this holds inside a
    text as well.  Of the rest, passages that an earlier document has word for word go wherever they begin: all
    of ``least_words + WINNOW - 1`` words or more, but for up to ``WINNOW - 1`` words at each end, and shorter
    ones of at least ``least_words`` words if they hold a chosen window.  ``kept_in`` lists the documents that keep the removed paragraphs.  NULL and empty texts
    have no paragraphs; rows without an id keep all; rows repeated with the same id and text are one document, so both keep what it keeps;
    other columns play no part; an empty table gives an empty result.
    """
    rows = marked(docs, key, text)
    whole = settle(repeated_paragraphs(rows, **options).where("NOT kept").select("doc_id", "mark", "begin", "end", "kept_in"))
    passages = repeated_passages(rows, whole, least_words=options.get("least_words", MIN_WORDS))
    removed = settle(whole.unionByName(passages))
    keepers = removed.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("kept_in")).alias("kept_in"))
    return without_spans(rows, removed).join(keepers, ["doc_id", "mark"], "left")


def removal_summary(out: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` from ``doc_id, text, kept_text, spans``."""
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    more = [c for c in ("kept_in",) if c in out.columns]
    return out.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept_text")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_text", 256).alias("kept_sha256"), *more
    )

