"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbrule.llm import conversation_repair, decontaminate, forest_join, language_id, lm_scoring, paragraph_dedup, quality_knn, robust_outliers, source_mix, suffix_dedup, token_counts, vector_codes, warc_bundles
from plumbrule.llm.vectors import crc_remainder
from plumbrule.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SQL_MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
o AS (
  SELECT *, sum(2.0 * source_size) OVER p AS caps, sum(weight) OVER p AS closed
  FROM w WINDOW p AS (ORDER BY 2.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
t AS (SELECT 1.5 * sum(source_size) AS total, sum(weight) AS all_weight FROM w),
l AS (
  SELECT min_by(level, own) AS level FROM (
    SELECT (total - caps + 2.0 * source_size) / (all_weight - closed + weight) AS level, 2.0 * source_size / weight AS own
    FROM o, t) WHERE level <= own),
g AS (
  SELECT source, source_size, round(least(weight * coalesce(level, 1e300), 2.0 * source_size), 6) AS target FROM w, l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
q AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS rest FROM p),
r AS (
  SELECT d.doc_id, d.size, d.source, q.source_size, q.target, q.whole, q.rest, d.place,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id) AS BIGINT) AS run
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (
  SELECT source, min_by(run, (abs(run - rest), run)) AS stop FROM (
    SELECT source, run, rest FROM r WHERE rest > 0
    UNION ALL SELECT source, 0, rest FROM q WHERE rest > 0) GROUP BY source)
SELECT r.doc_id, r.size, r.source, r.source_size, r.target, r.whole,
       CAST(r.size * (r.whole + CASE WHEN r.run <= e.stop THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""


def vector_codes_sql(rounds: int = 6) -> str:
    """Quantisation with plain whole-number sums: one table of assignments and one of entries for every round."""
    steps = [
        r"""
q AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, t.part, list_slice(v, t.part * len(v) // 8 + 1, (t.part + 1) * len(v) // 8) AS s
  FROM q, (SELECT unnest(range(8)) AS part) t),
c0 AS MATERIALIZED (
  SELECT part, e.entry, s FROM p JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM q ORDER BY vec_id LIMIT 16) e USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""
g{r} AS MATERIALIZED (
  SELECT p.vec_id, p.part, p.label, p.s, c.entry,
         CAST(list_sum(list_transform(range(1, len(p.s) + 1), lambda i: (p.s[i] - c.s[i]) * (p.s[i] - c.s[i]))) AS BIGINT) AS gap
  FROM p JOIN c{r} c USING (part)),
a{r} AS MATERIALIZED (
  SELECT vec_id, part, label, s, entry, gap FROM g{r}
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY gap, entry) = 1)""")
        if r < rounds:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n
  FROM (SELECT part, entry, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM a{r}) GROUP BY part, entry, i),
k{r} AS MATERIALIZED (
  SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY i) AS s FROM m{r} GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(k.s, c.s) AS s FROM c{r} c LEFT JOIN k{r} k USING (part, entry))""")
    return (
        "WITH"
        + ",".join(steps)
        + f""",
e AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code,
         CAST(sum(gap) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id),
h AS (
  SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS digest FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       digest AS codebooks_sha256
FROM e, h"""
    )


@query("op1_paragraph_dedup")
def op1(spark, sf_dir):
    return paragraph_dedup.removal_summary(paragraph_dedup.dedup_paragraphs(table(spark, sf_dir, "documents")))


@query("op2_forest_join")
def op2(spark, sf_dir):
    return forest_join.join_texts(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark, sf_dir):
    return language_id.identify_languages(table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 5) == 0)


@query("op4_source_mix", SQL_MIX)
def op4(spark, sf_dir):
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


@query("op5_suffix_dedup")
def op5(spark, sf_dir):
    return paragraph_dedup.removal_summary(suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")))


@query("op6_robust_outliers")
def op6(spark, sf_dir):
    return robust_outliers.robust_quality(table(spark, sf_dir, "documents"))


@query("op7_warc_bundles")
def op7(spark, sf_dir):
    return warc_bundles.archive_pages(table(spark, sf_dir, "pages"))


@query("op8_token_counts")
def op8(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_quality_knn")
def op9(spark, sf_dir):
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    return quality_knn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


@query("op10_decontaminate")
def op10(spark, sf_dir):
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_conversation_repair")
def op11(spark, sf_dir):
    return conversation_repair.repair_digest(table(spark, sf_dir, "conversations"))


@query("op12_lm_scoring")
def op12(spark, sf_dir):
    return lm_scoring.documents_to_score(table(spark, sf_dir, "documents"))


@query("op13_vector_codes", vector_codes_sql())
def op13(spark, sf_dir):
    return vector_codes.code_digest(table(spark, sf_dir, "embeddings"))
