"""Similarity join of texts by a MinHash LSH forest.

Every text has one label of ``DEPTH`` minimum hashes per tree.  A tree is the prefix trie of its labels: a
node of the trie is the bucket of texts that share a prefix.  The join begins with whole labels and shortens
the prefix by one number at a time, text by text: a text goes on while the estimated recall of its own pairs is
below the target, and meets all texts of its buckets, those that have stopped included.

Each verified pair of a text stands for as many as its chance to be found at this depth leaves unseen, and
every text is taken to have one more pair, at the similarity threshold, of which nothing has been seen.  So a
text without pairs stops only where such a pair is found with the target chance, and the pairs of one text say
nothing about those of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrule.llm.minhash import (
    BLOCK_NODES, BLOCK_SHINGLES, LEAST, SIMILARITY_BINS, SIZE, _overlaps, _roots, differing, groups_of, label_components, list_column, prefix_keys, recall_at, shingle_sets, signatures, unlike,
)
from plumbrule.llm.steps import settle
from plumbrule.llm.text import blocks, digests, packed, plain_strings, raw_bytes, shingle_hashes, tokens

TREES = 16
DEPTH = 8
RECALL = 0.995


def least_depth(trees: int, least: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold is still found with the wanted chance."""
    depth = 1
    while recall_at(least, depth + 1, trees) >= recall:
        depth += 1
    return depth


def _words(block: pa.RecordBatch):
    buf, offsets = raw_bytes(plain_strings(block.column(block.schema.get_field_index("text")), lower=True))
    _, _, words, counts = tokens(buf, offsets)
    return words, counts


def _sign(trees: int, depth: int, floor: int, size: int):
    """Names of texts and the keys of their shortest prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words, counts = _words(block)
            shingles, sizes = shingle_hashes(words, counts, size)
            keys = prefix_keys(signatures(shingles, sizes, trees * depth), trees, floor)
            columns = [block.column(block.schema.get_field_index("doc_id")), pa.array(digests(words, counts), pa.binary()), pa.array(sizes.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(k) for k in keys.T]], names=["doc_id", "node", "n_shingles", *[f"t{i}" for i in range(trees)]])

    return run


def sets_of_texts(trees: int, depth: int, floor: int, size: int = SIZE):
    """Rows ``node, shingles`` of a block of whole texts, and the keys of every depth."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sets, signature = [], [], [np.zeros((0, trees * depth), np.uint32)]
        for block in blocks(iter([batch])):
            words, counts = _words(block)
            shingles, sizes = shingle_hashes(words, counts, size)
            nodes += digests(words, counts)
            ends = np.cumsum(sizes)
            sets += [np.unique(shingles[b - n : b]) for b, n in zip(ends, sizes)]
            signature.append(signatures(shingles, sizes, trees * depth))
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        signed = np.concatenate(signature)
        keys = [list_column(prefix_keys(signed, trees, d)) for d in range(floor, depth + 1)]
        columns = [pa.array(nodes, pa.binary()), packed(flat, np.array([len(s) for s in sets], np.int64)), *keys]
        return pa.RecordBatch.from_arrays(columns, names=["node", "shingles", *[f"k{d}" for d in range(floor, depth + 1)]])

    return run


def open_buckets(state: DataFrame, depth: int, deepest: int, trees: int) -> DataFrame:
    """``tree, key, members, weight, opened, opened_weight`` of the buckets that an open text has to look through.

    ``state`` has ``node, n_shingles, open`` and the keys.  Buckets in which all pairs were compared before are
    left out.  One aggregate, combined before the shuffle: ``state`` has only texts that meet another one somewhere.
    """
    own = f"k{depth}"
    known = [(own, True)] + ([(f"k{depth + 1}", False)] if depth < deepest else [])
    words, done = unlike(known, trees)
    marked = state.select("n_shingles", "open", own, *[column.alias(word) for word, column in words])
    slots = marked.select("n_shingles", "open", *[word for word, _ in words], F.posexplode(own).alias("tree", "key"))
    full = slots.groupBy("tree", "key").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight"), F.count_if("open").alias("opened"), F.sum(F.when(F.col("open"), F.col("n_shingles"))).alias("opened_weight"), *differing(words)
    )
    return full.where((F.col("members") > 1) & (F.col("opened") > 0) & ~done).select("tree", "key", "members", "weight", "opened", "opened_weight")


def _cells(nodes: DataFrame, state: DataFrame, own: str, buckets: DataFrame) -> DataFrame:
    """One row per text and cell of two blocks of a bucket.

    Open texts fill the first blocks, the others the rest, and a cell has at least one block of open texts: those
    that have stopped are not compared with each other.  A bucket that fits one block is one cell.
    """
    parts = lambda n, w: F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    whole = parts(F.col("members"), F.col("weight"))
    rest = F.when(F.col("opened") < F.col("members"), parts(F.col("members") - F.col("opened"), F.col("weight") - F.col("opened_weight"))).otherwise(0)
    sized = buckets.select(
        "tree", "key", F.when(whole == 1, 1).otherwise(parts(F.col("opened"), F.col("opened_weight"))).alias("first"), F.when(whole == 1, 0).otherwise(rest).alias("rest")
    )
    rows = state.select("node", "open", F.posexplode(own).alias("tree", "key")).join(sized.hint("merge"), ["tree", "key"])
    draw = F.xxhash64("node")
    later = ~F.col("open") & (F.col("rest") > 0)
    place = F.when(later, F.col("first") + F.pmod(draw, F.greatest("rest", F.lit(1)))).otherwise(F.pmod(draw, F.col("first")))
    rows = rows.withColumn("own", place.cast("int"))
    others = F.sequence(F.lit(0), F.when(later, F.col("first")).otherwise(F.col("first") + F.col("rest")) - 1)
    rows = rows.withColumn("other", F.explode(others))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("first", "rest", "other")
    return rows.join(nodes.hint("merge"), "node")


PAIRED = "node binary, root binary, n_texts long, n_copies long, similar array<long>"


def _paired(rows: dict, tree: int, low: int, high: int, least: float, own: str, before: str | None) -> pa.RecordBatch | None:
    """Rows of the texts of a cell with a new pair: a text linked with them, partners, and these by similarity."""
    sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
    sizes = np.array([len(s) for s in sets], np.float32)
    shared = _overlaps(sets)
    jaccard = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
    linked = jaccard >= least - 1e-6
    np.fill_diagonal(linked, False)
    looks = np.array(rows["open"], bool)
    linked &= looks[:, None] | looks[None, :]
    if low != high:  # pairs inside a block belong to another cell
        block = np.array(rows["own"])
        linked &= block[:, None] != block[None, :]
    # a pair belongs to its lowest tree; where longer prefixes are equal, it was compared at that depth
    for name, trees in ((own, tree), (before, None)):
        for column in np.array(rows[name]).T[:trees] if name else ():
            linked &= column[:, None] != column[None, :]
    at = np.flatnonzero(linked.any(axis=1))
    if not len(at):
        return None
    linked, jaccard = linked[np.ix_(at, at)], jaccard[np.ix_(at, at)]
    root, copies = at[_roots(linked)], np.array(rows["copies"], np.int64)[at]
    level = np.clip(((jaccard - least) / (1 - least + 1e-9) * SIMILARITY_BINS).astype(int), 0, SIMILARITY_BINS - 1)
    similar = np.bincount((np.arange(len(at))[:, None] * SIMILARITY_BINS + level)[linked], minlength=len(at) * SIMILARITY_BINS).reshape(-1, SIMILARITY_BINS)
    names = rows["node"]
    columns = [pa.array([names[i] for i in at], pa.binary()), pa.array([names[i] for i in root], pa.binary()), pa.array(linked.sum(axis=1).astype(np.int64)), pa.array(linked.astype(np.int64) @ copies)]
    return pa.RecordBatch.from_arrays([*columns, list_column(similar.astype(np.int64))], names=["node", "root", "n_texts", "n_copies", "similar"])


def verified_pairs(nodes: DataFrame, state: DataFrame, buckets: DataFrame, depth: int, deepest: int, least: float) -> DataFrame:
    """``node, root, n_texts, n_copies, similar`` of texts with new pairs in some buckets, each pair counted once for both sides."""
    own, before = f"k{depth}", f"k{depth + 1}" if depth < deepest else None
    arrays = [own] + ([before] if before else [])
    used = ["tree", "key", "low", "high"]
    cells = _cells(nodes.select("node", "copies", "shingles", *arrays), state, own, buckets)
    placed = cells.repartition(*used).sortWithinPartitions(*used, "node").select("node", "copies", "shingles", "own", "open", *arrays, *used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _, low, high), rows in groups_of(batches, used):
            found = _paired(rows, int(tree), int(low), int(high), least, own, before)
            if found is not None:
                yield found

    return placed.mapInArrow(run, PAIRED)


def estimated_recall(similar: list, depth: int, trees: int, least: float):
    """Share of a text's pairs that is found at ``depth``, from its counts of found pairs by similarity.

    A found pair stands for one over its chance; one pair at the threshold is added, of which nothing is known.
    """
    chance = [float(recall_at(least + (1 - least) * i / SIMILARITY_BINS, depth, trees)) for i in range(SIMILARITY_BINS)]
    return (sum(similar) + chance[0]) / (sum(n * (1 / c) for n, c in zip(similar, chance)) + 1)


def unfinished(state: DataFrame, found: DataFrame, depth: int, trees: int, least: float, recall: float) -> DataFrame:
    """``state`` for the next depth: which of the open texts go on to shorter prefixes; a text that has stopped stays so."""
    counts = [f"s{i}" for i in range(SIMILARITY_BINS)]
    sums = found.groupBy("node").agg(*[F.sum(F.col("similar")[i]).alias(c) for i, c in enumerate(counts)])
    seen = [F.coalesce(F.col(c), F.lit(0)) for c in counts]
    goes_on = F.col("open") & (estimated_recall(seen, depth, trees, least) < recall)
    kept = state.drop(f"k{depth + 1}").columns
    return state.join(sums.hint("merge"), "node", "left").select(*[goes_on.alias(c) if c == "open" else c for c in kept])


def similarity_join(
    docs: DataFrame, *, least: float = LEAST, size: int = SIZE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, node`` of every row; ``node, first_id, copies, label, n_texts, n_copies`` of every different text).

    ``node`` stands for the words of a text, ``label`` for its component; ``n_texts`` counts the different
    texts with a similarity of at least ``least`` and ``n_copies`` the documents that have them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    floor = least_depth(trees, least, recall)
    names = [f"t{i}" for i in range(trees)]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, node binary, n_shingles long, " + ", ".join(f"{t} long" for t in names)
    signed = settle(rows.mapInArrow(_sign(trees, depth, floor, size), schema))
    members = signed.select("doc_id", "node")
    # one row per different text; keys are equal for equal words, and this is combined before the shuffle
    distinct = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), *[F.min(t).alias(t) for t in names]
    )
    distinct = settle(distinct.select("node", "first_id", "copies", "n_shingles", F.array(*names).alias("keys")))
    slots = distinct.select("node", F.posexplode("keys").alias("tree", "key"))
    crowd = slots.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = settle(slots.join(crowd.hint("merge"), ["tree", "key"], "left_semi").select("node").distinct())
    met = settle(distinct.drop("keys").join(met.hint("merge"), "node", "left_semi").withColumnRenamed("first_id", "doc_id"))
    more = "".join(f", k{d} array<long>" for d in range(floor, depth + 1))
    nodes = settle(met.join(shingle_sets(rows, met.select("doc_id", "node"), sets_of_texts(trees, depth, floor, size), more), "node"))
    distinct = distinct.drop("keys")
    found = spark.createDataFrame([], PAIRED)
    # what buckets are found from travels with the state, apart from the sets
    state = settle(nodes.select("node", "n_shingles", F.lit(True).alias("open"), *[f"k{d}" for d in range(floor, depth + 1)]))
    for d in range(depth, floor - 1, -1):
        if state.where("open").isEmpty():
            break
        buckets = settle(open_buckets(state, d, depth, trees))
        found = found.unionByName(settle(verified_pairs(nodes, state, buckets, d, depth, least)))
        if d > floor:
            state = settle(unfinished(state, found, d, trees, least, recall))
    labels = label_components(nodes.select("node"), found)
    sums = found.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_copies").alias("n_copies"))
    linked = labels.join(sums, "node", "left")
    out = distinct.join(linked, "node", "left").select(
        "node", "first_id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("n_copies", F.lit(0)).alias("n_copies")
    )
    return members, settle(out)


def join_texts(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, class_id, text_id, n_links, n_linked_texts`` of every row.

    ``class_id`` is the smallest document of the connected class, ``text_id`` the smallest with the same
    words; ``n_links`` counts the other documents at least that similar, copies included, and
    ``n_linked_texts`` the different texts.  Texts are compared by their lower-case words; a text with fewer
    words than a shingle is one shingle.  Texts without words (NULL, empty, only marks) link with nothing and
    are classes of their own.  Repeated rows count as documents; other columns play no part.
    """
    members, texts = similarity_join(docs, **options)
    classes = texts.groupBy("label").agg(F.min("first_id").alias("class_id"))
    info = texts.join(classes, "label").select("node", F.col("first_id").alias("text_id"), "class_id", (F.col("n_copies") + F.col("copies") - 1).alias("n_links"), F.col("n_texts").alias("n_linked_texts"))
    out = members.join(info, "node", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("text_id", "doc_id").alias("text_id"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_linked_texts", zero).alias("n_linked_texts"),
    )
