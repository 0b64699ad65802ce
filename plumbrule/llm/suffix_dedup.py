"""Removal of byte strings that also start in an earlier document, by longest-previous-factor arrays.

A string of ``length`` bytes is removed where the longest factor that begins there and also begins in an
earlier document has that length.  Suffixes are compared within small sets that hold all their equals:

1. Of every window of ``length`` bytes the smallest hash of ``GRAM`` bytes is its anchor.  Equal windows have
   equal anchors, and neighbouring windows mostly share one, so there are about ``length / 3`` times fewer
   anchors than bytes.  Anchors seen in one document only are dropped; they cannot repeat.
2. The runs of windows with the other anchors are sent, with their bytes, to the task of their anchor.  There
   the suffixes are sorted to the depth of ``length`` by prefix doubling, neighbours are compared for their
   common prefixes, and the previous and the next suffix of a smaller document give the longest previous
   factor: the longer of the two prefixes shared with these.  Factors of ``length`` bytes are earlier matches.
3. The spans of all matched windows of a document are merged and cut out.

An anchor with a large share of all rows would fill one task.  Each map task first merges what it has of an
anchor, and the few anchors above a share of all are cut up further: their windows are sent on one by one, by
their own hashes.  That changes only which task compares what.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrule.llm.paragraph_dedup import marked, without_spans
from plumbrule.llm.steps import settle
from plumbrule.llm.text import blocks, mix, packed, plain_strings, raw_bytes, span_hashes

LENGTH = 50
GRAM = 18
#: Anchors, or segments, that a task merges before it sends them on.
CHUNK = 500_000
#: An anchor with this share of all is cut up by its windows; there are at most as many as the inverse.
HEAVY_SHARE = 1 / 5_000_000
HEAVY_LEAST = 2_000
#: Bytes of segments sorted at once, so that the ranks stay in the processor's cache.
SORTED_BYTES = 1 << 18
_PLACE = np.uint64((1 << 26) - 1)


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchor_runs(buf: np.ndarray, offsets: np.ndarray, length: int):
    """(text, first window, number of windows, anchor) of every run of windows with one anchor.

    Windows lie inside one text; the first window counts from the start of the block.
    """
    width = length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if len(buf) < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    starts = np.arange(len(buf) - GRAM + 1)
    gram = span_hashes(buf, starts, starts + GRAM)
    least = _slide((gram & ~_PLACE) | (starts.astype(np.uint64) & _PLACE), width)
    window = starts[: len(least)]
    place = window - (window & int(_PLACE)) + (least & _PLACE).astype(np.int64)
    place = np.where(place < window, place + int(_PLACE) + 1, place)
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    inside = window + length <= offsets[text + 1]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [len(window)]]))
    keep = inside[head]
    head, size = head[keep], size[keep]
    return text[head], head, size, gram[place[head]]


_ANCHORS = pa.schema([("route", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])


def _merged_anchors(keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """Rows of one chunk, ``n`` documents of the chunk having the anchor.

    An anchor of one document goes to the task of the anchor, which decides on it.  One that repeats here needs
    no decision: a single row without document goes there as evidence, and its documents go elsewhere.
    """
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    keys, docs = keys[new], docs[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    head = np.flatnonzero(first)
    n = np.diff(np.concatenate([head, [len(keys)]]))
    known = np.repeat(n > 1, n)
    evidence = head[n > 1]
    signed = keys.view(np.int64)
    route = np.concatenate([np.where(known, mix(docs.astype(np.uint64)).view(np.int64), signed), signed[evidence]])
    doc = pa.array(np.concatenate([docs, docs[evidence]]), mask=np.concatenate([np.zeros(len(docs), bool), np.ones(len(evidence), bool)]))
    count = np.concatenate([np.where(known, 0, 1), n[n > 1]])
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(np.concatenate([signed, signed[evidence]])), doc, pa.array(count)], schema=_ANCHORS)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for block in blocks(batches):
            buf, offsets = raw_bytes(plain_strings(block.column(1)))
            text, _, _, key = anchor_runs(buf, offsets, length)
            keys.append(key)
            docs.append(block.column(0).to_numpy(zero_copy_only=False)[text])
            held += len(key)
            if held >= CHUNK:
                yield _merged_anchors(np.concatenate(keys), np.concatenate(docs))
                keys, docs, held = [], [], 0
        if held:
            yield _merged_anchors(np.concatenate(keys), np.concatenate(docs))

    return run


def _repeated(heavy_from: int):
    """Anchors in several documents, as ``doc_id, key``; heavy ones also as a row without document.

    The partition is sorted by route and anchor; an anchor that spans two batches is carried over.
    """

    def decide(route, key, doc, n, absent):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (route[1:] != route[:-1])
        head = np.flatnonzero(new)
        total = np.add.reduceat(n, head)
        size = np.diff(np.concatenate([head, [len(key)]]))
        out = (np.repeat(total, size) != 1) & ~absent
        heavy = head[total >= heavy_from]
        docs = pa.array(np.concatenate([doc[out], doc[heavy]]), mask=np.concatenate([np.zeros(out.sum(), bool), np.ones(len(heavy), bool)]))
        return pa.RecordBatch.from_arrays([docs, pa.array(np.concatenate([key[out], key[heavy]]))], names=["doc_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column(2)
            columns = [*[batch.column(i).to_numpy() for i in (0, 1)], doc.fill_null(0).to_numpy(), batch.column(3).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield decide(*[c[:cut] for c in columns])
            rest = [c[cut:] for c in columns]
        if rest is not None:
            yield decide(*rest)

    return run


SEGMENTS = "route long, doc_id long, mark long, begin long, size long, segment binary"
_SEGMENTS = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("begin", pa.int64()), ("size", pa.int64()), ("segment", pa.binary())])


def _gathered(buf: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes of all spans one after another."""
    shift = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return buf[np.repeat(begin - shift, sizes) + np.arange(sizes.sum())]


def _merged_segments(parts: list[tuple], length: int) -> pa.RecordBatch:
    """Rows of one chunk: of equal segments only that of the smallest document is compared on.

    The windows of the other documents are matched already: their rows have no segment and an own route.
    """
    route, doc, mark, begin, size, code = (np.concatenate([p[i] for p in parts]) for i in range(6))
    data = np.concatenate([p[6] for p in parts])
    widths = size + length - 1
    ends = np.cumsum(widths)
    order = np.lexsort((doc, code, route))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (route[a] == route[b]) & (code[a] == code[b]) & (size[a] == size[b])
    # equal hashes only propose; the bytes decide
    pair = np.flatnonzero(same)
    if len(pair):
        width = widths[order[pair]]
        sides = (_gathered(data, (ends - widths)[order[pair - i]], width) for i in (0, 1))
        same[pair] = np.logical_and.reduceat(np.equal(*sides), np.cumsum(width) - width)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    later[order] = doc[order] > doc[order[head]]
    # two rows of the same smallest document both go on
    sent = np.flatnonzero(~later)
    segments = packed(_gathered(data, (ends - widths)[sent], widths[sent]), widths[sent])
    done = np.flatnonzero(later)
    both = np.concatenate([sent, done])
    routes = np.concatenate([route[sent], mix(doc[done].view(np.uint64)).view(np.int64)])
    blank = pa.nulls(len(done), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(routes), pa.array(doc[both]), pa.array(mark[both]), pa.array(begin[both]), pa.array(size[both]), pa.concat_arrays([segments, blank])], schema=_SEGMENTS
    )


def _segments(length: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.sort(heavy.value)
        parts, held = [], 0
        for block in blocks(batches):
            ids, marks = (block.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buf, offsets = raw_bytes(plain_strings(block.column(2)))
            text, begin, size, key = anchor_runs(buf, offsets, length)
            lists = block.column(3)
            wanted = lists.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            tag = lambda k, t: mix(k + mix(t.astype(np.uint64)))
            use = np.isin(tag(key, text), tag(wanted, owner))
            text, begin, size, key = text[use], begin[use], size[use], key[use]
            frequent = np.isin(key, many)
            if frequent.any():  # one row per window, each with a route of its own
                n = size[frequent]
                one = np.repeat(begin[frequent], n) + np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                own = mix(span_hashes(buf, one, one + length) + np.uint64(1))
                text = np.concatenate([text[~frequent], np.repeat(text[frequent], n)])
                begin = np.concatenate([begin[~frequent], one])
                size = np.concatenate([size[~frequent], np.ones(len(one), np.int64)])
                key = np.concatenate([key[~frequent], own])
            if not len(text):
                continue
            code = span_hashes(buf, begin, begin + size + length - 1)
            parts.append((key.view(np.int64), ids[text], marks[text], begin - offsets[text], size, code, _gathered(buf, begin, size + length - 1)))
            held += len(text)
            if held >= CHUNK // 5:
                yield _merged_segments(parts, length)
                parts, held = [], 0
        if held:
            yield _merged_segments(parts, length)

    return run


def _dense(code: np.ndarray) -> np.ndarray:
    """Rank of each number, equal numbers sharing one."""
    order = np.argsort(code)
    ordered = code[order]
    out = np.empty(len(code), np.uint64)
    new = np.ones(len(code), np.uint64)
    new[1:] = ordered[1:] != ordered[:-1]
    out[order] = np.cumsum(new)
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers in their order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)


def depth_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each start in the order of its first ``length`` bytes; equal strings share a rank.

    As in prefix doubling, the order of longer strings follows from the ranks of two or three parts, which may
    overlap; only the places that a later step asks for are ranked.
    """
    steps, depth = [], min(8, length)
    while depth < length:
        new = min(3 * depth, length)
        steps.append([0, new - depth] if new <= 2 * depth else [0, depth, new - depth])
        depth = new
    places = [starts]
    for offsets in reversed(steps):
        asked = np.zeros(len(data), bool)
        for o in offsets:
            asked[places[-1] + o] = True
        places.append(np.flatnonzero(asked))
    place = places.pop()
    code = _words(data)[place] >> np.uint64(8 * max(0, 8 - length))
    full = np.zeros(len(data), np.uint64)
    rank = _dense(code)
    for offsets in steps:
        full[place] = rank
        place = places.pop()
        base = np.uint64(len(data) + 1)
        code = full[place + offsets[0]]
        for o in offsets[1:]:
            if len(data) >= 1 << 21:  # three ranks would not fit one number
                code = _dense(code)
            code = code * base + full[place + o]
        rank = _dense(code)
    return rank - np.uint64(1)


def common_prefixes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, ``length`` at most; 0 for the first.

    ``starts`` stand in suffix order.  Eight bytes are compared at once; the first that differ hold the end.
    """
    word = _words(data)
    out = np.full(len(starts), length, np.int64)
    out[:1] = 0
    pairs = np.arange(1, len(starts))
    for at in range(0, length, 8):
        differ = word[starts[pairs] + at] ^ word[starts[pairs - 1] + at]
        ends = differ != 0
        first = differ[ends]
        first &= ~(first >> np.uint64(1))  # a float of this has the exponent of the highest bit, without rounding up
        bit = (first.astype(np.float64).view(np.int64) >> 52) - 1023
        out[pairs[ends]] = np.minimum(at + 7 - (bit >> 3), length)
        pairs = pairs[~ends]
        if not len(pairs):
            break
    return out


def _shared_with_smaller(doc: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the nearest one before it of a smaller document, 0 without such.

    Every suffix points at one before it, with the bytes shared up to there; all between belong to documents
    that are not smaller.  So where the target is not smaller either, its own pointer is taken over, for all
    suffixes at once; the distances grow as in pointer doubling.
    """
    near, low = np.arange(len(doc)) - 1, shared.copy()
    todo = np.flatnonzero(low > 0)
    todo = todo[doc[near[todo]] >= doc[todo]]
    while len(todo):
        over = near[todo]
        low[todo] = np.minimum(low[todo], low[over])
        near[todo] = near[over]
        todo = todo[(near[todo] >= 0) & (low[todo] > 0)]
        todo = todo[doc[near[todo]] >= doc[todo]]
    return np.where(near >= 0, low, 0)


def previous_factors(data: np.ndarray, starts: np.ndarray, rank: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Length of the longest factor at each start that also starts in an earlier document, ``length`` at most.

    The longest match among the suffixes of smaller documents is the nearest of these before or after the
    suffix in suffix order: the previous or the next smaller document.
    """
    if len(rank) and len(data) < 1 << 24 and doc.min() >= 0 and doc.max() < 1 << 40:
        order = np.argsort((rank << np.uint64(40)) | doc.astype(np.uint64))
    else:
        order = np.lexsort((doc, rank))
    new = np.ones(len(order), bool)
    new[1:] = rank[order[1:]] != rank[order[:-1]]
    # of one rank only the first document looks beyond: the others share the whole length with it
    head = np.flatnonzero(new)
    shared = common_prefixes(data, starts[order[head]], length)
    least = doc[order[head]]
    before = _shared_with_smaller(least, shared)
    after = _shared_with_smaller(least[::-1], np.concatenate([shared[:1], shared[:0:-1]]))[::-1]
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.where(doc[order] > least[group], length, np.maximum(before, after)[group])
    return out


SPANS = "doc_id long, mark long, begin long, end long"


def _matches(length: int):
    def spans(rows: pa.Table) -> pa.RecordBatch:
        """Spans of the matched windows of some segments; rows without a segment are matched as a whole."""
        absent = rows.column("segment").is_null().to_numpy()
        doc, mark, begin, size = (rows.column(c).to_numpy() for c in ("doc_id", "mark", "begin", "size"))
        out = [(doc[absent], mark[absent], begin[absent], begin[absent] + size[absent] + length - 1)]
        own = np.flatnonzero(~absent)
        if len(own):
            data, offsets = raw_bytes(pa.chunked_array(rows.column("segment").chunks).combine_chunks().drop_null().cast(pa.large_binary()))
            n = size[own]
            row = np.repeat(np.arange(len(own)), n)
            step = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            starts = offsets[row] + step
            hit = previous_factors(data, starts, depth_ranks(data, starts, length), doc[own][row], length) >= length
            start, stop = hit.copy(), hit.copy()
            start[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
            stop[:-1] &= ~(hit[1:] & (row[1:] == row[:-1]))
            at, to = np.flatnonzero(start), np.flatnonzero(stop)
            of = own[row[at]]
            out.append((doc[of], mark[of], begin[of] + step[at], begin[of] + step[to] + length))
        columns = [np.concatenate([o[i] for o in out]) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "mark", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # cut where the route changes, once enough bytes are held
            route = batch.column(0).to_numpy()
            lengths = np.cumsum(batch.column(5).is_valid().to_numpy(zero_copy_only=False) * (batch.column(4).to_numpy() + length - 1))
            done = 0
            while done < batch.num_rows:
                before = lengths[done - 1] if done else 0
                want = int(np.searchsorted(lengths, before + max(SORTED_BYTES - size, 0), "right"))
                if held and size >= SORTED_BYTES and route[done] != held[-1].column(0)[-1].as_py():
                    yield spans(pa.Table.from_batches(held))
                    held, size = [], 0
                    continue
                if want >= batch.num_rows:
                    end = batch.num_rows
                else:
                    end = max(want, done + 1)
                    ahead = np.flatnonzero(route[end:] != route[end - 1])
                    end = end + int(ahead[0]) if len(ahead) else batch.num_rows
                held.append(batch.slice(done, end - done))
                size += int(lengths[end - 1] - before)
                done = end
                if done < batch.num_rows and size >= SORTED_BYTES:
                    yield spans(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, mark, begin, end``: byte spans whose every window of ``length`` bytes has an earlier match.

    ``docs`` has whole-numbered ``doc_id``, ``mark`` and ``text``.  Spans of a document may overlap.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings have at least {GRAM + 8} bytes")
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL")
    size = F.octet_length("text").cast("long")
    ids = settle(docs.where(size >= length).select("doc_id", "mark", F.md5(F.col("text").cast("binary")).alias("sum"), size.alias("n")))
    total = ids.agg(F.sum("n")).first()[0] or 0
    copies = ids.groupBy("sum").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    dead = settle(ids.join(copies.hint("merge"), "sum").where("doc_id > first_id").select("doc_id", "mark", "n").distinct())
    heavy_from = max(HEAVY_LEAST, int(total / (length / 3) * HEAVY_SHARE))
    rows = docs.where(size >= length)
    anchors = rows.select("doc_id", "text").mapInArrow(_anchors(length), "route long, key long, doc_id long, n long")
    pairs = settle(anchors.repartition("route").sortWithinPartitions("route", "key").mapInArrow(_repeated(heavy_from), "doc_id long, key long"))
    # bounded: every one of these stands for heavy_from anchors
    heavy = np.array([r["key"] for r in pairs.where("doc_id IS NULL").select("key").distinct().collect()], np.int64).view(np.uint64)
    lists = pairs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    live = ids.select("doc_id", "mark").distinct().join(dead.select("doc_id", "mark").hint("merge"), ["doc_id", "mark"], "left_anti").join(lists.hint("merge"), "doc_id")
    live = settle(live)
    # live grows with the input, so it is never broadcast
    texts = rows.join(live.hint("merge"), ["doc_id", "mark"]).select("doc_id", "mark", "text", "keys")
    segments = texts.mapInArrow(_segments(length, spark.sparkContext.broadcast(heavy)), SEGMENTS)
    spans = segments.repartition("route").sortWithinPartitions("route").mapInArrow(_matches(length), SPANS)
    spans = settle(spans)
    return spans.unionByName(dead.select("doc_id", "mark", F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))


def dedup_substrings(docs: DataFrame, *, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, text, kept_text, spans`` of every row, with the bytes of repeated strings cut out.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller ``doc_id``;
    matches never cross documents, and all strings are judged on the input.  NULL and short texts keep all;
    rows with equal ids are the same document and never remove from each other; equal texts fall to the
    smallest id.  Ids are whole numbers; rows without one keep all and match nothing.  Other columns play no part; an empty table gives an empty result.
    """
    rows = marked(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return without_spans(rows, repeated_spans(rows, length))
