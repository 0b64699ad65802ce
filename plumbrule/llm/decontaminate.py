"""Benchmark passages in documents, by the CGK embedding and bit sampling.

Texts are read as lower-case words with single spaces, in UTF-8 bytes.  A document holds an item if some part
of it is within ``SHARE`` of the item's length in edit distance.

1. Windows begin at words, in scripts without spaces at every code point, and have the length of a class of items.  A window that has an item keeps a known
   number of the item's byte 8-grams, so windows with fewer 8-grams of the class are passed over at once; no
   window with an item is.  In classes whose items may keep no 8-gram, no window is passed over.
2. The random walk of Chakraborty, Goldenberg and Koucky turns window and item into strings in which few edits
   make few differences: it copies the byte under a pointer, and a random bit of (step, byte) moves the pointer.
   Several walks, each sampled at several sets of steps, give the keys; a shared key makes a candidate.  The
   number of keys is set so that an item with the most edits allowed is found with the target recall.
3. Candidates are verified by the exact edit distance of the item to the best part of the window's surroundings.

What is broadcast has a fixed size: a bitmap, a table of class bits, and the random bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrule.core.session import cut_lineage
from plumbrule.llm.text import TOKEN, blocks, mix, packed, plain_strings, raw_bytes, spaceless_breaks

SHARE = 0.08
GRAM = 8
CLASS_RATIO = 1.1
WALKS = 8
TABLES = 16
SAMPLES = 5
#: Walk steps for one byte of an item that are sampled; the pointer moves at about every second step.
STEPS = 1.7
GRAM_BITS = 22
KEY_BITS = 26
BLOCK_BYTES = 2 << 20
#: Of the candidate starts in so many bytes one is verified, in a region that holds the item wherever it starts there.
PART = 64
#: Pairs verified at once; from ``FEW_PAIRS`` on by columns of bits, if their letters and tables keep to ``PAIR_CELLS`` numbers.
FEW_PAIRS = 128
MANY_PAIRS = 2048
PAIR_CELLS = 1 << 22
_GRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def plain_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words of each text with single spaces and a zero behind the text, offsets of the texts)."""
    buf, offsets = raw_bytes(plain_strings(column, lower=True))
    word = TOKEN[buf]
    before = np.concatenate([[False], word[:-1]])
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    keep = np.insert(word | before, offsets[1:], True)
    out = np.insert(np.where(word, buf, np.uint8(32)), offsets[1:], 0)
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[offsets + np.arange(len(offsets))]


def gram_codes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    for i in range(8):
        out[i::8] = padded[i : i + len(out)].view("<u8")
    return out[:n]


def gram_slots(buf: np.ndarray) -> np.ndarray:
    return ((gram_codes(buf) * _GRAM_FACTOR) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def class_of(length: int) -> int:
    """Smallest length of the class that a length belongs to."""
    low = GRAM
    while True:
        up = max(low + 1, int(low * CLASS_RATIO))
        if length < up:
            return low
        low = up


def class_end(low: int) -> int:
    return max(low + 1, int(low * CLASS_RATIO))


def kept_grams(low: int, share: float) -> int:
    """8-grams that a window of the class's length keeps of an item with the most edits; below 1 it may keep none."""
    return low - GRAM + 1 - GRAM * int(share * (class_end(low) - 1))


def random_bits(steps: int, seed: int = 3) -> np.ndarray:
    """One bit per walk, step and byte; the zero behind a text never moves the pointer."""
    drawn = mix(np.arange(WALKS * steps * 4, dtype=np.uint64) + np.uint64(seed << 40))
    bits = np.unpackbits(drawn.view(np.uint8)).reshape(WALKS, steps, 256).astype(np.int8)
    bits[:, :, 0] = 0
    return bits


def sampled_steps(low: int) -> np.ndarray:
    """Steps of every walk and table for a class."""
    drawn = mix(np.arange(WALKS * TABLES * SAMPLES, dtype=np.uint64) + np.uint64(low << 32))
    return (drawn % np.uint64(max(2, int(STEPS * low)))).astype(np.int64).reshape(WALKS, TABLES, SAMPLES)


def walk(buf: np.ndarray, starts: np.ndarray, steps: np.ndarray, bits: np.ndarray) -> Iterator[np.ndarray]:
    """For each walk the copied bytes, one row per step; ``steps`` falls, and each start is walked that far."""
    active = np.searchsorted(-steps, -np.arange(1, int(steps.max(initial=0)) + 1), "right")
    for own in bits:
        out, at = np.zeros((len(active), len(starts)), np.uint8), starts.copy()
        for j, k in enumerate(active):
            letter = buf[at[:k]]
            out[j, :k] = letter
            at[:k] += own[j][letter]
        yield out


def sampled_keys(buf: np.ndarray, starts: np.ndarray, lows: np.ndarray, bits: np.ndarray, met=None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the pair, key) of each pair of start and class, for every table.

    A start with several classes is walked once, as far as the largest needs.  ``met`` tells which keys to keep.
    """
    places, own = np.unique(starts, return_inverse=True)
    largest = np.zeros(len(places), np.int64)
    np.maximum.at(largest, own, lows)
    order = np.argsort(-largest, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    column = rank[own]
    groups = [(int(low), np.flatnonzero(lows == low)) for low in np.unique(lows)]
    groups = [(low, pairs[np.argsort(column[pairs], kind="stable")]) for low, pairs in groups]
    number, keys = [], []
    for w, copied in enumerate(walk(buf, places[order], np.maximum(2, (STEPS * largest[order]).astype(np.int64)), bits)):
        for low, pairs in groups:
            steps = sampled_steps(low)[w]
            used, back = np.unique(steps, return_inverse=True)
            part = copied[used][:, column[pairs]]
            for t, at in enumerate(back.reshape(steps.shape)):
                code = np.full(len(pairs), low * WALKS * TABLES + w * TABLES + t, np.uint64)
                for s in at:
                    code = (code << np.uint64(8)) | part[s]
                keep = slice(None) if met is None else met(code)
                number.append(pairs[keep])
                keys.append(code[keep])
    return (np.concatenate(number), np.concatenate(keys)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def key_slots(keys: np.ndarray) -> np.ndarray:
    """Bit of each key in the bitmap."""
    return ((keys * _GRAM_FACTOR) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def _by_rows(items: list[bytes], regions: list[bytes]) -> np.ndarray:
    """:func:`semi_global` row by row of the table of edit distances, for few pairs or long items."""
    n, m = max(map(len, items)), max(map(len, regions))
    item = np.zeros((len(items), n), np.int16)
    region = np.full((len(items), m), -1, np.int16)
    for i, (a, b) in enumerate(zip(items, regions)):
        item[i, : len(a)] = np.frombuffer(a, np.uint8)
        region[i, : len(b)] = np.frombuffer(b, np.uint8)
    step = np.arange(m + 1, dtype=np.int32)
    row = np.zeros((len(items), m + 1), np.int32)
    lengths, out = np.array([len(a) for a in items]), np.zeros(len(items), np.int64)
    for i in range(n):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (region != item[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - step, axis=1) + step
        ended = lengths == i + 1
        if ended.any():
            out[ended] = row[ended].min(axis=1)
    return out


def _by_bits(items: list[bytes], regions: list[bytes]) -> np.ndarray:
    """:func:`semi_global` by columns of bits (Myers, 1999): a word holds the steps of 64 rows; all items need as many words."""
    one, last = np.uint64(1), np.uint64(63)
    number = {a: i for i, a in enumerate(dict.fromkeys(items))}
    words, m = (len(items[0]) + 63) // 64, max(map(len, regions))
    # the rows at which an item has a letter; the letter 256, which fills up the regions, is in none
    equal = np.zeros((words, len(number) * 257), np.uint64)
    for a, i in number.items():
        at = np.arange(len(a), dtype=np.uint64)
        np.bitwise_or.at(equal, ((at >> np.uint64(6)).astype(np.int64), i * 257 + np.frombuffer(a, np.uint8).astype(np.int64)), one << (at & last))
    letters = np.full((len(items), m), 256, np.int32)
    for i, b in enumerate(regions):
        letters[i, : len(b)] = np.frombuffer(b, np.uint8)
    letters += np.array([number[a] * 257 for a in items], np.int32)[:, None]
    letters = np.ascontiguousarray(letters.T)
    distance = np.array([len(a) for a in items], np.int64)
    edge = ((distance - 1) % 64).astype(np.uint64)
    best, none = distance.copy(), np.zeros(len(items), np.uint64)
    rise, fall = [~none for _ in range(words)], [none.copy() for _ in range(words)]
    for column in letters:
        up, down = none, none  # steps along the row above the word; the row above the item is 0 everywhere
        for w in range(words):
            same, r, f = equal[w].take(column), rise[w], fall[w]
            vertical = same | f
            same |= down
            level = same & r
            level += r
            level ^= r
            level |= same
            plus = level | r
            np.invert(plus, out=plus)
            plus |= f
            minus = level
            minus &= r
            if w == words - 1:
                distance += ((plus >> edge) & one).view(np.int64)
                distance -= ((minus >> edge) & one).view(np.int64)
            else:
                next_up, next_down = plus >> last, minus >> last
            plus <<= one
            plus |= up
            minus <<= one
            minus |= down
            np.bitwise_and(plus, vertical, out=f)
            vertical |= plus
            np.invert(vertical, out=vertical)
            np.bitwise_or(vertical, minus, out=r)
            if w < words - 1:
                up, down = next_up, next_down
        np.minimum(best, distance, out=best)
    return best


def semi_global(items: list[bytes], regions: list[bytes]) -> np.ndarray:
    """Edit distance of each item to the best part of its region, for all at once."""
    words = np.array([(len(a) + 63) // 64 for a in items])
    out = np.zeros(len(items), np.int64)
    for w in np.unique(words[words > 0]):
        own = np.flatnonzero(words == w)
        own = own[np.argsort([len(regions[k]) for k in own], kind="stable")]
        at, longest = 0, max(len(regions[own[-1]]), 1)
        many = min(MANY_PAIRS, PAIR_CELLS // longest, PAIR_CELLS // (257 * int(w)))
        while at < len(own):
            part = own[at : at + (many if many >= FEW_PAIRS else FEW_PAIRS)]
            how = _by_bits if many >= FEW_PAIRS and len(part) >= FEW_PAIRS else _by_rows
            out[part] = how([items[k] for k in part], [regions[k] for k in part])
            at += len(part)
    return out


@dataclass(frozen=True)
class Index:
    """What every task needs; of fixed size but for the random bits, which grow with the longest item.

    ``grams`` has for every slot of 8-grams one bit per class, classes beyond 32 sharing bits.
    """

    grams: np.ndarray
    keys: np.ndarray
    lows: tuple[int, ...]
    bits: np.ndarray
    share: float


_SIGNED = "item_id long, item binary, low int, grams array<long>, slots array<long>, keys array<long>"


def _sign(bits_for):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(iter([batch]), limit=BLOCK_BYTES):
                buf, offsets = plain_bytes(block.column(1))
                lengths = np.diff(offsets) - 1
                use = np.flatnonzero(lengths >= GRAM)
                if not len(use):
                    continue
                lows = np.array([class_of(int(n)) for n in lengths[use]], np.int64)
                number, keys = sampled_keys(buf, offsets[:-1][use], lows, bits_for(int(lows.max())))
                order = np.argsort(number, kind="stable")
                ends = np.searchsorted(number[order], np.arange(len(use) + 1))
                slots = gram_slots(buf)
                grams = [np.unique(slots[offsets[i] : offsets[i] + lengths[i] - GRAM + 1]).tolist() for i in use]
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(pa.array(use)), pa.array([buf[offsets[i] : offsets[i] + lengths[i]].tobytes() for i in use], pa.binary()), pa.array(lows.astype(np.int32)),
                     pa.array(grams, pa.list_(pa.int64())), *[pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in (key_slots(keys[order]), keys[order].view(np.int64))]],
                    names=["item_id", "item", "low", "grams", "slots", "keys"],
                )

    return run


def _class_bits(signed: DataFrame, lows: list[int]) -> np.ndarray:
    """Bits of the classes that have each 8-gram slot; at most ``2**GRAM_BITS`` rows come to the driver."""
    number = (F.array_position(F.array(*map(F.lit, lows)), F.col("low")) - 1) % 32
    bits = signed.select(F.explode("grams").alias("slot"), number.cast("int").alias("class")).groupBy("slot").agg(F.expr("bit_or(shiftleft(1L, class))").alias("bits")).toArrow()
    out = np.zeros(1 << GRAM_BITS, np.uint32)
    out[bits.column("slot").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    return out


def _bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """Bits at the given ``slot`` numbers; the driver gets at most ``2**bits / 64`` rows, and packs them into ``2**bits / 8`` bytes."""
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).collect()
    out = np.zeros((1 << bits) // 64, np.int64)
    for row in words:
        out[row["word"]] = row["bits"]
    return out.view(np.uint8)


def _is_set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def dense_starts(hits: np.ndarray, first: np.ndarray, low: int, least: int) -> np.ndarray:
    """Numbers of the words in ``first`` at which a window of ``low`` bytes begins with ``least`` hits or more."""
    if least < 1:
        return np.arange(len(first))
    if len(hits) < least:
        return np.zeros(0, np.int64)
    room = low - GRAM
    dense = np.flatnonzero(hits[least - 1 :] - hits[: len(hits) - least + 1] <= room)
    begin = np.searchsorted(first, hits[dense + least - 1] - room)
    end = np.searchsorted(first, hits[dense], "right")
    step = np.zeros(len(first) + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, np.maximum(begin, end), -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


def region_of(starts: np.ndarray, lows: np.ndarray, share: float, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of what is compared with the items of a class, within the texts from ``begin`` to ``end``."""
    room = (lows * CLASS_RATIO * 2 * share).astype(np.int64) + 16 + PART
    return np.maximum(starts - room, begin), np.minimum(starts + (lows * CLASS_RATIO).astype(np.int64) + room, end)


_WINDOWS = "doc_id long, mark long, start long, region binary, keys array<long>"


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for block in blocks(batches, limit=BLOCK_BYTES):
            buf, offsets = plain_bytes(block.column(2))
            classes = index.grams[gram_slots(buf)]
            hits = np.flatnonzero(classes)
            classes = classes[hits]
            word = buf > 32
            fresh = ~np.concatenate([[False], word[:-1]])
            fresh[spaceless_breaks(buf[:-1])] = True
            first = np.flatnonzero(word & fresh)
            starts, lows = [], []
            for i, low in enumerate(index.lows):
                own = dense_starts(hits[classes >> np.uint32(i % 32) & np.uint32(1) > 0], first, low, kept_grams(low, index.share))
                starts.append(own)
                lows.append(np.full(len(own), low))
            at, lows = np.concatenate(starts), np.concatenate(lows)
            text = np.searchsorted(offsets, first, "right") - 1
            end = offsets[text + 1] - 1
            if not len(at):
                continue
            number, keys = sampled_keys(buf, first[at], lows, index.bits, lambda codes: _is_set(index.keys, key_slots(codes)))
            if not len(number):
                continue
            order = np.lexsort((number, at[number]))
            number, keys = number[order], keys[order]
            place = at[number]
            used, begin = np.unique(place, return_index=True)
            longest = np.maximum.reduceat(lows[number], begin)
            low_end, high_end = region_of(first[used], longest, index.share, offsets[text[used]], end[used])
            ends = np.concatenate([begin, [len(keys)]]).astype(np.int32)
            size = high_end - low_end
            shift = np.concatenate([[0], np.cumsum(size)[:-1]])
            region = packed(buf[np.repeat(low_end - shift, size) + np.arange(size.sum())], size)
            rows = pa.array(text[used])
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(rows), block.column(1).take(rows), pa.array(first[used] - offsets[text[used]]), region, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))],
                names=["doc_id", "mark", "start", "region", "keys"],
            )

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, regions = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        distance = semi_global(items, regions)
        lengths = np.array([len(a) for a in items], np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(distance), pa.array(lengths)], names=["doc_id", "mark", "item_id", "start", "distance", "length"])


def find_items(docs: DataFrame, items: DataFrame, *, share: float = SHARE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", by_text: bool = False) -> DataFrame:
    """``doc_id, item_id, start, distance, similarity`` of every document and item that it holds.

    With ``by_text`` the result also has ``mark``, the xxhash64 of the text, and different texts under one id stay apart.

    ``start`` is a byte of the document's words with single spaces, near which the best part begins;
    ``distance`` counts the edits from the item to it, at most ``share`` of the item's length.  NULL and empty
    documents, and those without an id, hold nothing; NULL items and items with fewer than eight bytes of words are not searched for.  Equal items are all
    reported; rows with the same id and text are one document; ids are whole numbers; other columns play no
    part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    signed = cut_lineage(wanted.mapInArrow(_sign(lambda low: random_bits(max(2, int(STEPS * low)))), _SIGNED))
    lows = sorted(r["low"] for r in signed.select("low").distinct().collect())
    own = ["doc_id", "mark"] if by_text else ["doc_id"]
    if not lows:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in own) + ", item_id long, start long, distance long, similarity double")
    index = Index(
        _class_bits(signed, lows),
        _bitmap(signed.select(F.explode("slots").alias("slot")), KEY_BITS),
        tuple(lows),
        random_bits(max(2, int(STEPS * lows[-1]))),
        share,
    )
    windows = cut_lineage(rows.mapInArrow(_find(spark.sparkContext.broadcast(index)), _WINDOWS))
    asked = windows.select("doc_id", "mark", "start", F.explode("keys").alias("key"))
    known = signed.select("item_id", F.explode("keys").alias("key"))
    votes = asked.join(known, "key").groupBy("doc_id", "mark", "item_id", "start").agg(F.count(F.lit(1)).alias("votes"))
    # neighbouring windows show the same part of a document; the one with most keys goes on
    best = votes.groupBy("doc_id", "mark", "item_id", F.floor(F.col("start") / PART).alias("part")).agg(F.max(F.struct("votes", F.negative("start").alias("back"))).alias("best"))
    chosen = best.select("doc_id", "mark", "item_id", (-F.col("best.back")).alias("start"))
    pairs = chosen.join(signed.select("item_id", "item"), "item_id").join(windows.select("doc_id", "mark", "start", "region").dropDuplicates(["doc_id", "mark", "start"]), ["doc_id", "mark", "start"])
    checked = pairs.select("doc_id", "mark", "item_id", "start", "item", "region").mapInArrow(_verify, "doc_id long, mark long, item_id long, start long, distance long, length long")
    found = checked.where(F.col("distance") <= F.floor(F.col("length") * share))
    nearest = found.groupBy(*own, "item_id").agg(F.min(F.struct("distance", "start", "length")).alias("b"))
    return nearest.select(*own, "item_id", "b.start", "b.distance", (1.0 - F.col("b.distance") / F.col("b.length")).alias("similarity"))


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, item_ids, n_items, similarity`` of the documents that hold an item."""
    found = find_items(docs, items, **options)
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_items"), F.max("similarity").alias("similarity"))
