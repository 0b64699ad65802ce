"""Benchmark items where windows are hard to come by, and copies in scripts without spaces."""

import numpy as np

from plumbrule.llm import decontaminate, forest_join, paragraph_dedup
from plumbrule.llm.text import raw_bytes, spaceless_breaks, tokens
from tests.llm.common import documents, prose


def letters(seed: int, n: int, first: int = 0x4E00, size: int = 3000) -> str:
    return "".join(map(chr, first + np.random.default_rng(seed).integers(0, size, n)))


def test_items_inside_lines_without_spaces(spark):
    han, thai, mixed = letters(1, 40), letters(2, 60, 0x0E01, 46), "GPT" + letters(3, 30)
    edited = han[:20] + letters(4, 1) + han[21:]
    rows = [(1, letters(5, 101) + han + letters(6, 60)), (2, letters(7, 60, 0x0E01, 46) + thai + letters(8, 90, 0x0E01, 46)), (3, letters(9, 77) + mixed + letters(10, 50)), (4, letters(11, 90) + edited + letters(12, 9)), (5, letters(13, 300))]
    items = spark.createDataFrame([(1, han), (2, thai), (3, mixed)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(documents(spark, rows), items).collect()}
    assert {k: v for k, v in found.items() if k != (4, 1)} == {(1, 1): 0, (2, 2): 0, (3, 3): 0}
    assert 0 < found[4, 1] <= 3


def test_words_of_scripts_without_spaces():
    import pyarrow as pa

    texts = ["naïve größe", "我是GPT模型", "日本語 テスト。", "한국어 단어", "𠀀a"]
    buf, offsets = raw_bytes(pa.array(texts, pa.large_string()))
    starts, ends, _, counts = tokens(buf, offsets)
    words = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == ["naïve", "größe", "我", "是", "GPT", "模", "型", "日", "本", "語", "テ", "ス", "ト", "。", "한국어", "단어", "𠀀", "a"]
    assert counts.tolist() == [2, 5, 7, 2, 2]
    assert not len(spaceless_breaks(np.frombuffer(b"plain", np.uint8)))


def test_passages_of_scripts_without_spaces(spark):
    """A repeated line of Chinese characters is long enough to be compared."""
    line = "".join(chr(0x4E00 + (i * i * 7919 + 13 * i) % 5000) for i in range(80))
    rows = [(1, line), (2, "前" + line + "後"), (3, line)]
    out = {r["doc_id"]: r["kept_text"].decode() for r in paragraph_dedup.dedup_paragraphs(documents(spark, rows)).collect()}
    assert out[1] == line and out[3] == "" and len(out[2]) <= 2 + 2 * (paragraph_dedup.WINNOW - 1)


def test_near_copies_without_spaces(spark):
    text = [chr(0x4E00 + (i * i * 7919 + 13 * i) % 5000) for i in range(300)]
    rows = [(1, "".join(text)), (2, "".join([*text[:150], "改", *text[151:]])), (3, "".join(reversed(text)))]
    found = {r["doc_id"]: r["class_id"] for r in forest_join.join_texts(documents(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3}


def test_short_items_that_keep_no_gram(spark):
    """One letter changed in the middle of 15 leaves no run of eight."""
    words = [prose(i, 40, 3000).replace(".", "").lower().split() for i in range(200)]
    short = [(" ".join(w) * 3)[:15].strip() for w in words]
    rows = [(i, prose(1000 + i, 12) + " " + s[:7] + "q" + s[8:] + " " + prose(2000 + i, 12)) for i, s in enumerate(short) if len(s) == 15 and s[7] != " "]
    items = spark.createDataFrame([(i, short[i]) for i, _ in rows], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(documents(spark, rows), items).collect()}
    assert len(rows) > 100 and sum((i, i) in found for i, _ in rows) >= 0.95 * len(rows)


def test_regions_hold_items_that_start_anywhere_in_a_part():
    """A start 63 bytes before or behind an item of the class has the whole item in its region."""
    low = 100
    buf = np.frombuffer(b"ab " * 300, np.uint8)
    for shift in (-63, 63):
        begin, end = decontaminate.region_of(np.array([450]), np.array([low]), 0.08, np.array([0]), np.array([len(buf)]))
        last = 450 + shift + int(1.08 * (decontaminate.class_end(low) - 1))
        assert begin[0] <= 450 + shift and end[0] >= last
