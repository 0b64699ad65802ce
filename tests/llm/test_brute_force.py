"""The registered queries against brute force on the smallest table, and operators on planted cases."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from plumbrule.llm import decontaminate, forest_join, minhash, paragraph_dedup, robust_outliers, source_mix, suffix_dedup, token_counts, warc_bundles
from tests.llm.common import FOLDER, TOKEN, WORD, documents, prose, shingles

QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())


def rows_of(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, FOLDER).collect()}


def linked(sets, least=0.8):
    """All pairs of different ids with Jaccard similarity of at least ``least``."""
    where, out = defaultdict(list), defaultdict(set)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    for k, s in sets.items():
        for o, n in Counter(o for x in s for o in where[x] if o > k).items():
            if n >= least * (len(s) + len(sets[o]) - n) - 1e-9:
                out[k].add(o)
                out[o].add(k)
    return out


def classes(ids, links):
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in links:
        for o in links[k]:
            a, b = find(k), find(o)
            parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in ids}


def test_forest_join(spark, texts):
    found, links = rows_of(spark, "op2_forest_join"), linked({k: shingles(v) for k, v in texts.items()})
    wanted = sum(map(len, links.values()))
    assert sum(r["n_links"] for r in found.values()) >= 0.98 * wanted
    assert all(found[k]["n_links"] <= len(links[k]) for k in texts)
    assert {k: r["class_id"] for k, r in found.items()} == classes(texts, links)


def test_forest_join_counts_a_crowd_once(spark):
    """A group of exact and near copies that is larger than a block of the comparison."""
    words = prose(11, 60).split()
    rows = [(i, " ".join(words)) for i in range(50)]
    rows += [(50 + i, " ".join([*words[: i % 60], f"new{i}", *words[i % 60 + 1 :]])) for i in range(700)]
    found = {r["doc_id"]: r for r in forest_join.join_texts(documents(spark, rows)).collect()}
    links = linked({k: shingles(t) for k, t in rows})
    assert {r["class_id"] for r in found.values()} == {0}
    got, want = sum(r["n_links"] for r in found.values()), sum(map(len, links.values()))
    assert 0.98 * want <= got <= want


def test_depth_follows_the_target():
    floor = forest_join.least_depth(16, 0.8, 0.99)
    assert minhash.recall_at(0.8, floor, 16) >= 0.99 > minhash.recall_at(0.8, floor + 1, 16)


def brute_removal(texts, length=50):
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        gone, own = bytearray(len(raw)), set()
        for i in range(len(raw) - length + 1):
            own.add(raw[i : i + length])
            if raw[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
        seen |= own
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[k] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, texts):
    found = rows_of(spark, "op5_suffix_dedup")
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()} == brute_removal(texts)


def test_suffix_dedup_planted(spark, monkeypatch):
    """Passages at text borders, overlaps, runs of one byte, copies, cut characters, and heavy anchors."""
    passage = prose(21, 30)
    rows = {1: passage, 2: "x" + passage + "y", 3: passage[10:] + "é" * 60, 4: "é" * 70, 5: "a" * 300, 6: "b" + "a" * 120 + "c", 7: passage + passage, 8: passage}
    rows |= {100 + i: prose(300 + i, 20) + " " + passage + " " + prose(600 + i, 20) for i in range(60)}
    wanted = brute_removal(rows)
    for heavy in (suffix_dedup.HEAVY_LEAST, 5):
        monkeypatch.setattr(suffix_dedup, "HEAVY_LEAST", heavy)
        out = paragraph_dedup.removal_summary(suffix_dedup.dedup_substrings(documents(spark, rows.items()).repartition(7))).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == wanted


def test_suffix_order():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 350)
    rank = suffix_dedup.depth_ranks(data, starts, 50)
    strings = [data[i : i + 50].tobytes() for i in starts]
    order = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert [order[s] for s in strings] == rank.tolist()


def test_paragraphs(spark):
    shared, other = prose(31, 70), prose(32, 70)
    near = shared.replace(shared.split()[35], "changed", 1)
    rows = [(1, other + "\n" + shared), (2, prose(33, 40) + "\n" + shared + "\n" + prose(34, 40)), (3, near + "\n" + prose(35, 40)), (4, prose(36, 90)), (5, shared + "\n" + shared), (6, "short line\n" + prose(37, 60))]
    out = {r["doc_id"]: r for r in paragraph_dedup.dedup_paragraphs(documents(spark, rows)).collect()}
    kept = {k: r["kept_text"].decode() for k, r in out.items()}
    assert kept[1] == rows[0][1] and kept[4] == rows[3][1] and kept[6] == rows[5][1]
    # pieces of a line with fewer words than a paragraph may stay
    assert kept[2].startswith(prose(33, 40)) and kept[2].endswith(prose(34, 40)) and len(kept[2].split()) < 80 + 35
    assert len(kept[5].split()) < 70 and out[5]["kept_in"] == [1]
    assert near not in kept[3] and prose(35, 40) in kept[3]


def test_paragraphs_cover_the_text(texts):
    import pyarrow as pa

    column = pa.array(list(texts.values()))
    text, begin, end, _, _ = paragraph_dedup.paragraphs(column)
    for i, t in enumerate(texts.values()):
        own = text == i
        if own.any():
            assert begin[own][0] == 0 and end[own][-1] == len(t.encode()) and (begin[own][1:] == end[own][:-1]).all()


def test_paragraph_query_catches_long_lines(spark, texts):
    found, seen = rows_of(spark, "op1_paragraph_dedup"), set()
    for k in sorted(texts):
        lines = {x for x in texts[k].split("\n") if len(x.split()) >= 50}
        if lines & seen:
            assert found[k]["n_removed"] > 0
        seen |= lines
    for k, r in found.items():
        assert r["n_bytes"] == len(texts[k].encode()) and (r["n_removed"] > 0) == (r["kept_in"] is not None)


def test_languages_held_out(spark):
    found = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    known = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert known.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert known.where("score < 0 OR score > 1").isEmpty()


def test_quality_held_out(spark):
    found = QUERIES["op9_quality_knn"](spark, "/root/testdata/sf0.01").where("held_out")
    known = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right = known.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.95 and right[1] >= 0 and right[2] <= 1


def test_outlier_counts(spark, texts):
    found = rows_of(spark, "op6_robust_outliers")
    for k, t in texts.items():
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        wanted = (len(words), sum(map(len, words)), sum(c in robust_outliers.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered))
        r = found[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == wanted
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])


def brute_estimate(x):
    """The same concentration steps in numpy, with whole rows in place of bins of distances."""
    floors, p, h = np.array(robust_outliers.FLOORS) ** 2, x.shape[1], robust_outliers.SHARE
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    centre, cov = middle, np.diag(((high - low) / 1.349) ** 2 + floors)

    def distance(centre, cov):
        d = x - centre
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    for _ in range(30):
        near = x[np.argsort(distance(centre, cov))[: int(np.ceil(h * len(x)))]]
        centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) * robust_outliers._consistency(h, p) + np.diag(floors)
    near = x[distance(centre, cov) <= robust_outliers.chi2_point(0.975, p)]
    centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) * robust_outliers._consistency(0.975, p) + np.diag(floors)
    return distance(centre, cov)


def test_outlier_distances(spark):
    """Close to exact steps for the bulk, and the planted outliers are the ones that both reject."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, robust_outliers.P)) @ np.diag([1.0, 0.4, 0.5, 0.6, 0.5])
    x[:90] += 9
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x], ["grp", *[f"x{i}" for i in range(robust_outliers.P)]])
    estimate = robust_outliers.fit_groups(frame)
    got = frame.withColumn("id", F.monotonically_increasing_id()).join(estimate, "grp").withColumn("d", robust_outliers._distance()).orderBy("id").select("d")
    got, want = np.array([r["d"] for r in got.collect()]), brute_estimate(x)
    cut = robust_outliers.chi2_point(0.99999, robust_outliers.P)
    assert ((got > cut) == (want > cut)).all() and (got[:90] > cut).all() and (got[90:] < cut).mean() > 0.999
    assert np.median(np.abs(got / want - 1)) < 0.1


def test_chi_square():
    assert abs(robust_outliers.chi2_point(0.95, 5) - 11.0705) < 1e-3 and abs(robust_outliers.chi2_share(3.8415, 1) - 0.95) < 1e-4


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    last = {}
    for k in sorted(pages):
        last[pages[k]] = k
    for r in QUERIES["op7_warc_bundles"](spark, FOLDER).collect():
        raw = pages[r["page_id"]].encode()
        first = last[pages[r["page_id"]]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))


def test_records_by_place(spark, tmp_path):
    """A round trip through the files: every record is found again from its place, by frame."""
    import glob

    import zstandard

    pages = spark.createDataFrame([(i, f"http://h/{i}", prose(i, 4000) if i % 3 else "same") for i in range(60)], "page_id long, url string, html string")
    folder = str(tmp_path / "bundles")
    warc_bundles.write_bundles(pages.coalesce(2), folder)
    index = warc_bundles.record_index(spark, folder)
    assert index.count() == 60 and index.agg(F.max("frame")).first()[0] > 0
    asked = index.where(F.col("id").cast("int") % 7 == 1)
    found = {int(r["id"]): bytes(r["payload"]) for r in warc_bundles.read_records(spark, folder, asked).collect()}
    assert found == {i: prose(i, 4000).encode() if i % 3 else b"" for i in range(1, 60, 7)} | ({57: found[57]} if 57 in found else {})
    for path in glob.glob(f"{folder}/part-*"):
        with open(path, "rb") as f:
            bundle = f.read()
        table = warc_bundles.read_seek_table(bundle)
        plain = b"".join(warc_bundles.read_frame(bundle, i) for i in range(len(table)))
        assert zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() == plain


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted(texts)
    wanted = [len(e.ids) for e in tokenizer.encode_batch([texts[k] for k in ids], add_special_tokens=False)]
    found = rows_of(spark, "op8_token_counts")
    assert [found[k]["n_tokens"] for k in ids] == wanted
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) and r["n_bytes"] == len(texts[k].encode()) for k, r in found.items())


def test_token_counts_of_odd_texts(spark):
    from tokenizers import Tokenizer

    odd = ["a<|endoftext|> b <|endoftext|>", "x <|endoftext|>", " lead", "  two  spaces \n x", "", "tail ", "tail  ", "\x1c x\x85 y　 z", "é ​ q", "it's 'll x", "a \n\n  b", " ", "  ", "\n", "a\x1d b", "end.", "end.' 'x", "naïve, (word). 12.5 %", "wait...! what?!", "tab\t x", "don't.", "a. <|x", "日本 語。 x"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = token_counts.count_tokens(documents(spark, list(enumerate(odd))), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(odd)}


def test_piece_memory_may_be_small():
    path = public_tokenizers.path("byte_bpe_50k.json")
    some = [prose(i, 200) for i in range(10)]
    small, large = token_counts.PieceCounter(path, room=20), token_counts.PieceCounter(path)
    assert [small.count([t])[0] for t in some] == large.count(some).tolist()


def test_mix_against_targets(spark):
    rows = [(i, prose(i, 5 + i % 90), "en", f"s{i % 5}" if i % 11 else None) for i in range(900)] + [(1000 + i, prose(i, 40), "en", "big") for i in range(500)]
    first = source_mix.mix_sources(documents(spark, rows)).collect()
    assert sorted(first) == sorted(source_mix.mix_sources(documents(spark, rows).repartition(9)).collect())
    by = defaultdict(list)
    for r in first:
        by[r["source"]].append(r)
        assert r["size"] == len(WORD.findall(dict((x[0], x[1]) for x in rows)[r["doc_id"]])) and r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in first)
    open_sources = [s for s in by if by[s][0]["target"] < 2 * by[s][0]["source_size"] - 1e-3]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate([*sorted(x for x in by if x is not None), None])}
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1 or not open_sources
    assert len({round(by[s][0]["target"] / weight[s], 3) for s in open_sources}) <= 1
    for s, v in by.items():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)


def test_water_fill_all_closed(spark):
    weighted = spark.createDataFrame([("a", 10, 3.0), ("b", 0, 1.0)], "source string, source_size long, weight double")
    assert {r["source"]: r["target"] for r in source_mix.water_fill(weighted, 1000.0, 2.0).collect()} == {"a": 20.0, "b": 0.0}


def plain(text):
    return " ".join(TOKEN.findall(text.lower()))


def test_benchmark_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    items = dict(spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect())
    whole = {k: plain(t) for k, t in docs.items()}
    wanted = {(k, i) for i, t in items.items() for k, d in whole.items() if plain(t) in d}
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontaminate"](spark, folder).collect()} >= wanted


def edited(text, share, seed):
    rng = np.random.default_rng(seed)
    letters = list(text)
    for _ in range(int(share * len(text)) // 2):
        place, kind = int(rng.integers(len(letters))), int(rng.integers(3))
        letters[place : place + (kind != 1)] = [] if kind == 0 else ["q"]
    return "".join(letters)


def test_edited_items_are_found(spark):
    """Recall on planted items with edits, at text borders as well, and no clean document is named."""
    items = [(i, plain(prose(900 + i, 40))) for i in range(60)]
    docs = [(i, (prose(i, 50) + " " if i % 3 else "") + edited(t, 0.06, i) + (" " + prose(7000 + i, 50) if i % 2 else "")) for i, t in items]
    docs += [(1000 + i, prose(20_000 + i, 150)) for i in range(100)]
    found = decontaminate.find_items(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    right = {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] == r["item_id"]}
    assert len(right) >= 0.95 * len(items) and all(r["doc_id"] < 1000 for r in found)
    assert all(r["distance"] <= 0.08 * len(dict(items)[r["item_id"]]) for r in found)


def test_edit_distance():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    rng = np.random.default_rng(1)
    items = [bytes(rng.integers(97, 100, rng.integers(8, 20)).tolist()) for _ in range(40)]
    regions = [bytes(rng.integers(97, 100, rng.integers(1, 40)).tolist()) for _ in range(40)]
    assert decontaminate.semi_global(items, regions).tolist() == [brute(a, b) for a, b in zip(items, regions)]


def test_many_edit_distances_go_by_columns_of_bits(monkeypatch):
    """As many pairs as a task of candidates has, items of one to four words of bits, regions of any length."""
    rng = np.random.default_rng(2)
    letters = lambda n: bytes(rng.integers(97, 101, n).tolist())
    pool = [letters(n) for n in (8, 63, 64, 65, 127, 128, 129, 200, 250)]
    items = [pool[i] for i in rng.integers(0, len(pool), 1500)]
    regions = [letters(rng.integers(0, 60)) + a[: rng.integers(0, len(a) + 1)] + letters(rng.integers(0, 60)) for a in items]
    regions[0] = b""
    got = decontaminate.semi_global(items, regions).tolist()
    assert got == [int(decontaminate._by_rows([a], [b])[0]) for a, b in zip(items, regions)]
    monkeypatch.setattr(decontaminate, "_by_rows", lambda *a: 1 / 0)
    assert decontaminate.semi_global(items * 2, regions * 2).tolist() == got * 2


def test_pipeline_stages(spark):
    """Every stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [plain(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = dict(docs.select("doc_id", "text").collect())
        out = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        after = dict(out.select("doc_id", "text").collect())
        if name == "quality_knn":
            assert all(k in after for k in before if quality.get(k) == 1)
            assert sum(k in after for k in before if quality.get(k) == 0) <= 2
        elif name == "forest_join":
            links = linked({k: shingles(v) for k, v in before.items()})
            assert set(after) == set(classes(before, links).values())
        elif name == "suffix_dedup":
            removed = brute_removal(before)
            assert all(len(after[k].encode()) <= removed[k][0] - removed[k][1] for k in after)
            assert all(after[k] == before[k] for k in after if not removed[k][1])
            assert set(before) - set(after) == {k for k, r in removed.items() if r[0] == r[1] > 0}
        elif name == "decontaminate":
            assert set(before) - set(after) >= {k for k, t in before.items() if any(i in plain(t) for i in items)}
            assert len(before) - len(after) <= len(before) // 5
        else:
            assert set(after) <= set(before) and all(r["mix_copies"] in (1, 2) for r in out.collect())
            assert out.columns == [*docs.columns, "mix_target", "mix_copies"]
        if name != "source_mix":
            assert out.columns == docs.columns and set(after) <= set(before)
        docs = out
