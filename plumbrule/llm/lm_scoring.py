"""Texts scored by an interpolated modified Kneser-Ney bigram model that Spark counts.

Words are runs of visible bytes with A-Z in lower case, and every text ends with an end token.  A first pass
counts tokens, a second one pairs of neighbours.  The pairs of one left token are brought to one task, but
those of tokens that are a 4,096th of all tokens or more are dealt by pair; of these there are at most 4,096.
The task that owns a shard merges its sorted runs (`runs`) and writes sorted hash arrays: pairs with their
counts, left tokens with the size and spread of what follows them, tokens with their count and the number of
different tokens before them.  Workers map the arrays into memory and look up whole blocks of texts.

Probability of ``w`` after ``v``, with discounts D by count from the counts of counts:
``(c(vw) - D(c(vw))) / c(v) + gamma(v) * p(w)`` and ``p(w) = (l(w) - D'(l(w))) / L + gamma' / (V + 1)``, where
``l`` counts different left neighbours and ``V + 1`` leaves room for unknown words.  At the begin of a text
``v`` is a begin mark, which is never predicted.

Defined cases: NULL is an empty text, which has the end token only; repeated rows count repeatedly; without
training texts every token has probability 1 / (V + 1) = 1.  Nothing is pruned: the arrays grow with the corpus.
Keys are 64-bit hashes; two n-grams with one hash would be taken for one.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.llm import runs
from plumbrule.llm.steps import settle
from plumbrule.llm.text import _BASE, blocks, mix, plain_strings, raw_bytes, runs as byte_runs, span_hashes
from plumbrule.llm.vectors import crc_remainder

#: Bytes of text read at once; different pairs that a task holds before it packs them.
BLOCK_BYTES = 4_000_000
HELD = 3_000_000
#: Bytes of text that one shard stands for: what a merging task holds grows with it, the number of runs falls.
SHARD_BYTES = 24_000_000
#: Left tokens with this share of all tokens are dealt by pair.
HEAVY = 4096
END, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x6A09E667F3BCC909)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VISIBLE = np.ones(256, bool)
_VISIBLE[[0x20, *range(0x09, 0x0E)]] = False


def text_tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, texts one after another, end tokens included; their number per text)."""
    buf, offsets = raw_bytes(plain_strings(batch.column(batch.schema.get_field_index("text"))))
    buf = _LOWER[buf]
    starts, ends = byte_runs(_VISIBLE[buf], offsets)
    sizes = np.diff(np.searchsorted(starts, offsets))
    out = np.full(len(starts) + len(sizes), END)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(sizes)), sizes)] = span_hashes(buf, starts, ends)
    return out, sizes + 1


def left_tokens(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each, the begin mark before the first of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(sizes) - sizes] = BEGIN
    return out


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _BASE + right)


def _run_batch(dealt) -> pa.RecordBatch | None:
    rows = list(dealt)
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "n", "body"])


class _Counter:
    """Counts of keys with columns that go with them, merged whenever many are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, *others: np.ndarray) -> None:
        self.parts.append((keys, counts, *others))
        self.held += len(keys)
        if self.held > HELD:
            self.merge()

    def merge(self) -> None:
        keys, counts, *others = (np.concatenate(c) for c in zip(*self.parts))
        keys, (counts,), at = runs.merged(keys, counts)
        self.parts, self.held = [(keys, counts, *[o[at] for o in others])], len(keys)

    def full(self) -> bool:
        return self.held > HELD // 2

    def taken(self) -> tuple[np.ndarray, ...] | None:
        if not self.parts:
            return None
        self.merge()
        out, self.parts, self.held = self.parts[0], [], 0
        return out


def _count_tokens(shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()

        def packed():
            keys, counts = counter.taken()
            return _run_batch(runs.dealt(runs.shard_of(keys, shards), keys, [keys, counts]))

        for block in blocks(batches, limit=BLOCK_BYTES):
            tokens, _ = text_tokens(block)
            keys, (counts,), _ = runs.merged(tokens, np.ones(len(tokens), np.int64))
            counter.add(keys, counts)
            if counter.full():
                yield packed()
        if counter.parts:
            yield packed()

    return work


def _write_tokens(folder: str):
    """Arrays of the tokens of a shard; returns their number, their sum and those that may be heavy."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs.shard_groups(batches):
            keys, counts = runs.unpacked(rows, 2)
            keys, (counts,), _ = runs.merged(keys, counts.astype(np.int64))
            runs.write_array(folder, "token", shard, keys)
            runs.write_array(folder, "token.count", shard, counts)
            total = int(counts.sum())
            large = counts * HEAVY >= total
            kinds = ["types", "tokens"] + ["heavy"] * int(large.sum())
            yield pa.RecordBatch.from_pydict({"kind": kinds, "key": [0, 0, *keys[large].view(np.int64).tolist()], "n": [len(keys), total, *counts[large].tolist()]})

    return work


def _count_pairs(shards: int, heavy: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()

        def packed():
            keys, counts, left, right = counter.taken()
            return _run_batch(runs.dealt(_pair_shard(keys, left, heavy, shards), left, [left, right, counts]))

        for block in blocks(batches, limit=BLOCK_BYTES):
            tokens, sizes = text_tokens(block)
            left = left_tokens(tokens, sizes)
            keys, (counts,), at = runs.merged(pair_keys(left, tokens), np.ones(len(tokens), np.int64))
            counter.add(keys, counts, left[at], tokens[at])
            if counter.full():
                yield packed()
        if counter.parts:
            yield packed()

    return work


def _pair_shard(keys: np.ndarray, left: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    return runs.shard_of(np.where(np.isin(left, heavy), keys, left), shards)


_FACTS = "kind string, shard int, n long, body binary, key long, total long, ones long, twos long, more long"


def _fact_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split()[0] for c in _FACTS.split(", ")])


def _spread(kind: str, counts: np.ndarray) -> tuple:
    """How many counts are 1, 2, 3 and 4, and how many there are."""
    return (kind, 0, len(counts), None, 0, *[int((counts == i).sum()) for i in (1, 2, 3, 4)])


def _write_pairs(folder: str, shards: int, heavy: np.ndarray):
    """Arrays of the pairs and of the left tokens of a shard; returns runs of left neighbours for each right token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs.shard_groups(batches):
            left, right, counts = runs.unpacked(rows, 3)
            keys, (counts,), at = runs.merged(pair_keys(left, right), counts.astype(np.int64))
            left, right = left[at], right[at]
            runs.write_array(folder, "pair", shard, keys)
            runs.write_array(folder, "pair.count", shard, counts)
            one = np.ones(len(keys), np.int64)
            context, facts, _ = runs.merged(left, counts, *[(m).astype(np.int64) for m in (counts == 1, counts == 2, counts > 2)])
            split = np.isin(context, heavy)
            runs.write_array(folder, "left", shard, context[~split])
            for name, values in zip(("total", "ones", "twos", "more"), facts):
                runs.write_array(folder, f"left.{name}", shard, values[~split])
            out = [("left", 0, 0, None, int(k), *map(int, v)) for k, *v in zip(context[split].view(np.int64), *[f[split] for f in facts])]
            out.append(_spread("pairs", counts))
            after, (before,), _ = runs.merged(right, one)
            out += [("right", s, n, body, 0, 0, 0, 0, 0) for s, n, body in runs.dealt(runs.shard_of(after, shards), after, [after, before])]
            yield _fact_batch(out)

    return work


def _write_neighbours(folder: str):
    """The number of different tokens before each token, beside the tokens of the shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in runs.shard_groups(batches):
            after, before = runs.unpacked(rows, 2)
            after, (before,), _ = runs.merged(after, before.astype(np.int64))
            known, _ = runs.MappedArrays(folder, "token", [], 0).shard(shard)
            if not np.array_equal(known, after):
                raise RuntimeError("tokens and pairs were counted on different texts")
            runs.write_array(folder, "token.before", shard, before)
            yield _fact_batch([_spread("tokens", before)])

    return work


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and from 3 on; the usual 0.5, 1 and 1.5 where the counts of counts give none."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 <= d <= i for i, d in enumerate(found, 1)):
            return np.array([0.0, *found])
    return np.array([0.0, 0.5, 1.0, 1.5])


@dataclasses.dataclass(frozen=True)
class BigramModel:
    """Sizes and discounts; the counts themselves lie in ``folder``."""

    folder: str
    shards: int
    heavy: np.ndarray  #: heavy left tokens, sorted, and the facts of each: total, ones, twos, more
    heavy_facts: np.ndarray
    tokens: int
    types: int
    pair_types: int
    pair_discounts: np.ndarray
    token_discounts: np.ndarray
    rest: float  #: share of the unknown word before it is divided by ``types + 1``

    def lookups(self) -> "Lookups":
        return Lookups(self)


class Lookups:
    """The memory-mapped side of a model in one worker."""

    def __init__(self, model: BigramModel):
        self.model = model
        self.token = runs.MappedArrays(model.folder, "token", ["count", "before"], model.shards)
        self.pair = runs.MappedArrays(model.folder, "pair", ["count"], model.shards)
        self.left = runs.MappedArrays(model.folder, "left", ["total", "ones", "twos", "more"], model.shards)

    def token_facts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count in the training texts, lower-order probability) of sorted different tokens."""
        m = self.model
        count, before = self.token.find(keys)
        kept = (before - m.token_discounts[np.minimum(before, 3)]) / max(m.pair_types, 1)
        return count, kept + m.rest / (m.types + 1)

    def left_facts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how often a token stands left of another, share left to the lower order) of sorted different tokens."""
        m = self.model
        facts = np.stack(self.left.find(keys), axis=1)
        if len(m.heavy):
            at = np.minimum(np.searchsorted(m.heavy, keys), len(m.heavy) - 1)
            split = m.heavy[at] == keys
            facts[split] = m.heavy_facts[at[split]]
        total = facts[:, 0]
        return total, np.where(total > 0, (facts[:, 1:] @ m.pair_discounts[1:]) / np.maximum(total, 1), 1.0)

    def scores(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, log10 probability by smoothed counts of tokens, log10 probability of the model) of each text."""
        m = self.model
        begin = np.cumsum(sizes) - sizes
        keys, where = np.unique(tokens, return_inverse=True)
        count, lower = self.token_facts(keys)
        known = np.add.reduceat((count > 0)[where].astype(np.int64), begin)
        base = np.add.reduceat(np.log10((count + 1) / (m.tokens + m.types + 1))[where], begin)
        left = left_tokens(tokens, sizes)
        pairs, at, back = np.unique(pair_keys(left, tokens), return_index=True, return_inverse=True)
        own = left[at]
        contexts, context = np.unique(own, return_inverse=True)
        total, share = self.left_facts(contexts)
        (seen,) = self.pair.find(pairs, _pair_shard(pairs, own, m.heavy, m.shards))
        kept = (seen - m.pair_discounts[np.minimum(seen, 3)]) / np.maximum(total, 1)[context]
        chance = np.log10(kept + share[context] * lower[where[at]])
        return known, base, np.add.reduceat(chance[back], begin)


def train(texts: DataFrame, text: str = "text") -> BigramModel:
    """Count the model over all rows of ``texts`` and write its arrays to the shared folder."""
    spark = texts.sparkSession
    texts = texts.select(F.col(quoted(text)).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    folder = runs.array_folder(spark)
    run = "shard int, n long, body binary"
    counted = runs.by_shard(texts.mapInArrow(_count_tokens(shards), run), shards)
    known = settle(counted.mapInArrow(_write_tokens(folder), "kind string, key long, n long"))
    sums = {r["kind"]: r["n"] for r in known.where("kind <> 'heavy'").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    tokens, types = sums.get("tokens", 0), sums.get("types", 0)
    # at most HEAVY rows, since their counts add up to no more than all tokens
    heavy = [r["key"] for r in known.where((F.col("kind") == "heavy") & (F.col("n") * HEAVY >= tokens)).select("key").collect()]
    # as many begin marks as end tokens, so the mark is heavy whenever the end token is
    heavy = np.unique(np.append(np.array(heavy, np.int64).view(np.uint64), BEGIN))
    counted = runs.by_shard(texts.mapInArrow(_count_pairs(shards, heavy), run), shards)
    facts = settle(counted.mapInArrow(_write_pairs(folder, shards, heavy), _FACTS))
    before = runs.by_shard(facts.where("kind = 'right'"), shards).mapInArrow(_write_neighbours(folder), _FACTS)
    spreads = facts.where("kind = 'pairs'").unionByName(before).groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("n", "total", "ones", "twos", "more")])
    spread = {r["kind"]: r for r in spreads.collect()}
    split = facts.where("kind = 'left'").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("total", "ones", "twos", "more")]).collect()
    found = {r["key"]: list(r)[1:] for r in split}
    values = np.array([found.get(int(k), [0] * 4) for k in heavy.view(np.int64)], np.int64).reshape(-1, 4)
    by_pair = list(spread["pairs"])[2:] if spread else [0] * 4
    by_token = list(spread["tokens"])[2:] if spread else [0] * 4
    pair_types = spread["pairs"]["n"] if spread else 0
    cut = discounts(*by_token)
    rest = (cut[1] * by_token[0] + cut[2] * by_token[1] + cut[3] * (types - by_token[0] - by_token[1])) / pair_types if pair_types else 1.0
    return BigramModel(folder, shards, heavy, values, tokens, types, pair_types, discounts(*by_pair), cut, float(rest))


def score(docs: DataFrame, model: BigramModel, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``n_tokens, n_known, base_score, score`` of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = model.lookups()
        for block in blocks(batches, limit=BLOCK_BYTES):
            tokens, sizes = text_tokens(block)
            known, base, chance = lookups.scores(tokens, sizes)
            kept = [block.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes), pa.array(known), pa.array(base), pa.array(chance)], [*keep, "n_tokens", "n_known", "base_score", "score"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"{quoted(c)} {types[c]}" for c in keep) + ", n_tokens long, n_known long, base_score double, score double"
    return docs.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).alias("text")).mapInArrow(work, schema)


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; the model learns from rows that are not held out."""
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    model = train(rows.where(~F.col("held_out")))
    out = score(rows, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def documents_to_score(docs: DataFrame) -> DataFrame:
    """Documents scored by a model of those whose CRC remainder by 7 is not 2."""
    return score_documents(docs, crc_remainder(F.col("doc_id"), 7) == 2)
