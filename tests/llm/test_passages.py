"""Passages that stand anywhere in lines and sentences."""

from plumbrule.llm import paragraph_dedup
from tests.llm.common import documents, prose


def bare(seed: int, words: int) -> list[str]:
    return prose(seed, words, 3000).replace(".", "").lower().split()


def test_passages_inside_lines(spark):
    """Fifty words in the middle of a line, without sentence ends, in short lines, and with one word changed."""
    rows, passages = [], {}
    for i in range(60):
        passage = bare(1000 + i, 50)
        near = [*passage[:25], f"other{i}", *passage[26:]]
        join = "\n".join if i % 3 == 2 else " ".join
        lines = lambda w: join(" ".join(w[k : k + 5]) for k in range(0, len(w), 5))
        rows.append((i, lines([*bare(2000 + i, 40 + i % 7), *passage, *bare(3000 + i, 30)])))
        rows.append((100 + i, lines([*bare(4000 + i, 33), *(near if i % 3 == 1 else passage), *bare(5000 + i, 41)])))
        passages[100 + i] = passage
    out = {r["doc_id"]: r for r in paragraph_dedup.dedup_paragraphs(documents(spark, rows)).collect()}
    for k, text in rows:
        kept = out[k]["kept_text"].decode().split()
        if k < 100:
            assert out[k]["kept_text"].decode() == text and out[k]["kept_in"] is None
            continue
        gone = len(text.split()) - len(kept)
        assert out[k]["kept_in"] == [k - 100]
        assert kept[:33] == text.split()[:33] and kept[-41:] == text.split()[-41:]
        assert gone >= (15 if k % 3 == 2 else 50 - 2 * (paragraph_dedup.WINNOW - 1))


def test_passage_of_a_removed_paragraph_stays(spark):
    """A place that goes with its paragraph keeps no passage for others."""
    line = bare(1, 120)
    near = [*line[:60], "other", *line[61:]]
    rows = [(1, " ".join(line)), (2, " ".join(near)), (3, " ".join([*bare(2, 30), *near[53:68], *bare(3, 30)]))]
    out = {r["doc_id"]: r["kept_text"].decode() for r in paragraph_dedup.dedup_paragraphs(documents(spark, rows)).collect()}
    assert out == {1: rows[0][1], 2: "", 3: rows[2][1]}
