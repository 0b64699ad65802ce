"""Pairs at the threshold beside a crowd of very similar texts."""

from plumbrule.llm import forest_join
from tests.llm.common import documents, prose


def test_pairs_at_the_threshold_beside_a_crowd(spark):
    base = prose(1, 400, 3000).split()
    rows = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(300)]
    for i in range(400):
        words = prose(100 + i, 95, 3000).split()
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join([*words[:30], "one", *words[31:60], "two", *words[61:]]))]
    found = {r["doc_id"]: r for r in forest_join.join_texts(documents(spark, rows)).collect()}
    assert {found[i]["class_id"] for i in range(300)} == {0}
    assert sum(found[1001 + 2 * i]["class_id"] == 1000 + 2 * i for i in range(400)) >= 0.98 * 400
