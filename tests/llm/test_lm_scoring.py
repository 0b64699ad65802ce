"""The counted language model against dictionaries and against itself."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbrule.llm import lm_scoring, runs
from tests.llm.common import FOLDER, documents, edge_documents, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
END, BEGIN = ("end",), ("begin",)


def tokens(text):
    return [*WORD.findall((text or "").translate(UPPER)), END]


def discount(counts):
    n = [sum(1 for c in counts if c == i) for i in range(5)]
    out = [0, 0.5, 1.0, 1.5]
    if min(n[1:]) > 0:
        y = n[1] / (n[1] + 2 * n[2])
        own = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        if all(0 <= d <= i for i, d in enumerate(own)):
            out = own
    return lambda c: out[min(c, 3)]


class Plain:
    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for text in texts:
            words = tokens(text)
            self.count.update(words)
            self.pairs.update(zip([BEGIN, *words], words))
        self.follow, self.before = defaultdict(dict), Counter()
        for (v, w), n in self.pairs.items():
            self.follow[v][w] = n
            self.before[w] += 1
        self.pair_cut, self.token_cut = discount(self.pairs.values()), discount(self.before.values())
        self.rest = sum(map(self.token_cut, self.before.values())) / len(self.pairs) if self.pairs else 1.0

    def lower(self, w):
        n = self.before[w]
        return (n - self.token_cut(n)) / max(len(self.pairs), 1) + self.rest / (len(self.count) + 1)

    def chance(self, v, w):
        own = self.follow.get(v)
        if not own:
            return self.lower(w)
        total = sum(own.values())
        return (own.get(w, 0) - self.pair_cut(own.get(w, 0))) / total + sum(map(self.pair_cut, own.values())) / total * self.lower(w)

    def row(self, text):
        words = tokens(text)
        n, v = sum(self.count.values()), len(self.count)
        base = sum(math.log10((self.count[w] + 1) / (n + v + 1)) for w in words)
        return len(words), sum(self.count[w] > 0 for w in words), n, base, sum(math.log10(self.chance(a, b)) for a, b in zip([BEGIN, *words], words))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    model = Plain(t for k, t in rows if not held(k))
    expected = sorted(((k, held(k), *model.row(t)) for k, t in rows), key=repr)
    got = sorted(map(tuple, lm_scoring.documents_to_score(df).collect()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in expected], rtol=1e-9, atol=1e-9)
    return got


@pytest.mark.parametrize("shard_bytes", [24_000_000, 20_000])
def test_equals_dictionaries(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm_scoring, "SHARD_BYTES", shard_bytes)
    assert len(check(spark.read.parquet(f"{FOLDER}/documents.parquet"))) == 200


def test_edge_documents(spark):
    got = check(edge_documents(spark))
    assert len(got) == len(edge_rows())
    assert [r[2] for r in got if r[0] in (1, 2, 3)] == [1, 1, 1]


def test_rows_without_id_and_empty_table(spark):
    got = check(documents(spark, [(None, prose(5, 90)), (None, None), (3, prose(6, 90)), (3, "ÄÖ AB ab Ab")]))
    assert [r[1] for r in got if r[0] is None] == [False, False]
    assert lm_scoring.documents_to_score(documents(spark, [])).collect() == []


def test_nothing_to_learn_from(spark):
    only = next(i for i in range(100) if held(i))
    assert [tuple(r)[1:] for r in check(documents(spark, [(only, "some words"), (only, None)]))] == [(True, 1, 0, 0, 0.0, 0.0), (True, 3, 0, 0, 0.0, 0.0)]


def test_probabilities_sum_to_one(spark):
    texts = [prose(i, 200, 60) for i in range(8)] + ["a b", "b a c"]
    docs = documents(spark, list(enumerate(texts)))
    model = lm_scoring.train(docs)
    plain = Plain(texts)
    lookups = model.lookups()
    vocabulary = sorted(w for w in plain.count if w != END)
    block = docs.select("text").where(F.lit(False)).toArrow().to_batches()
    assert not sum(b.num_rows for b in block)
    import pyarrow as pa

    known, sizes = lm_scoring.text_tokens(pa.RecordBatch.from_pydict({"text": [" ".join([*vocabulary, "never-seen-before"])]}))
    keys = np.unique(known)
    assert len(keys) == model.types + 1
    _, lower = lookups.token_facts(keys)
    assert abs(lower.sum() - 1) < 1e-12
    for v in [lm_scoring.BEGIN, *known[:5], known[-2]]:
        pairs = lm_scoring.pair_keys(np.full(len(keys), v), keys)
        order = np.argsort(pairs)
        (seen,) = lookups.pair.find(pairs[order], lm_scoring._pair_shard(pairs[order], np.full(len(keys), v), model.heavy, model.shards))
        total, share = lookups.left_facts(np.array([v]))
        whole = ((seen - model.pair_discounts[np.minimum(seen, 3)]) / max(total[0], 1)).sum() + share[0]
        assert abs(whole - 1) < 1e-12


def test_held_out_texts_are_likelier_than_shuffled_ones(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    mixed = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), F.array_join(F.reverse(F.split("text", " ")), " ").alias("text"))
    model = lm_scoring.train(docs)
    mean = lambda d: lm_scoring.score(d, model, ["doc_id"]).agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert mean(docs) > mean(mixed) + 0.1


def test_runs_come_back_whole():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(1, 1 << 40, 5000).astype(np.uint64)
    parts = list(runs.dealt(runs.shard_of(keys, 7), keys, [keys, counts]))
    assert sorted(s for s, _, _ in parts) == list(range(7))
    back = [runs.unpack(body, n, 2) for _, n, body in parts]
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*back)))) == sorted(zip(keys.tolist(), counts.tolist()))
    assert all((np.diff(b[0].astype(float)) >= 0).all() for b in back)


def test_folder_that_workers_cannot_map(spark, monkeypatch):
    monkeypatch.setattr(runs, "shared_folder", lambda spark: "hdfs://somewhere/else")
    with pytest.raises(RuntimeError, match="mounted"):
        runs.array_folder(spark)
