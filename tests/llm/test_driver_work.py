"""Plans and jobs that the driver of the corpus pipeline has to hold."""

from plumbrule.llm import forest_join, source_mix
from tests.llm.common import documents


def _jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_open_buckets_are_one_shuffle(spark):
    """Buckets with an open text and a pair that is new at this depth; others are left out."""
    key = lambda x: x << 32 | 77
    rows = [  # name, open, keys of two trees at depth 7, and at depth 8
        ("a", True, (1, 11), (101, 111)), ("b", False, (1, 12), (102, 112)),  # met in tree 0, one is open
        ("c", False, (2, 13), (103, 113)), ("d", False, (2, 14), (104, 114)),  # both have stopped
        ("e", True, (3, 15), (105, 115)), ("f", True, (3, 16), (106, 115)),  # compared at depth 8
        ("g", True, (-4, 17), (107, 117)), ("h", True, (-4, 17), (108, 118)),  # tree 1 repeats tree 0
    ]
    data = [(bytearray(n.encode()), 3, o, [key(x) for x in k7], [key(x) for x in k8]) for n, o, k7, k8 in rows]
    state = spark.createDataFrame(data, "node binary, n_shingles long, open boolean, k7 array<long>, k8 array<long>")
    found = forest_join.open_buckets(state, 7, 8, 2)
    got = {(r["tree"], r["key"] >> 32, r["members"], r["weight"], r["opened"], r["opened_weight"]) for r in found.collect()}
    assert got == {(0, 1, 2, 6, 1, 3), (0, -4, 2, 6, 2, 6)}
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # initial and final plan


def test_sources_are_put_in_order_once(spark):
    docs = documents(spark, [(i, "one two three") for i in range(30)]).drop("source").selectExpr("*", "concat('s', doc_id % 3) AS source")
    before = _jobs(spark)
    assert source_mix.mix_sources(docs).count() == 30
    assert _jobs(spark) - before <= 60  # 38; with the sources put in order again in every round of the water-filling 75
