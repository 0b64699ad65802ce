"""Sequence-window and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbrule.functions import columns as fx
from plumbrule.operators import chatlog, sequence
from plumbrule.plans.associations import rounded
from plumbrule.plans.registry import query, table


def event_series(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


SERIES = """s AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS start, array_agg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS inputs,
   array_agg(value) OVER (w ROWS BETWEEN 5 FOLLOWING AND 7 FOLLOWING) AS targets, lead(value, 6) OVER w AS target
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(
    "sliding_windows",
    f"""WITH {SERIES} SELECT user_id, start, array_to_string(list_transform(inputs, lambda v: CAST(round(v * 100) AS BIGINT)), ',') AS inputs, target FROM s WHERE target IS NOT NULL""",
)
def q_windows(spark, sf_dir):
    out = sequence.sliding_windows(event_series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 5, 2)
    return out.withColumn("inputs", F.array_join(F.transform("inputs", lambda v: F.round(v * 100).cast("long").cast("string")), ","))


@query(
    "multi_horizon",
    f"""WITH {SERIES} SELECT user_id, start, round(list_sum(inputs), 4) AS input_sum, array_to_string(list_transform(targets, lambda v: CAST(round(v * 100) AS BIGINT)), ',') AS targets FROM s WHERE len(targets) = 3""",
)
def q_multi(spark, sf_dir):
    out = sequence.multi_horizon(event_series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 5, 3)
    out = out.withColumn("targets", F.array_join(F.transform("targets", lambda v: F.round(v * 100).cast("long").cast("string")), ","))
    return rounded(out.withColumn("input_sum", fx.total("inputs")), "input_sum", digits=4).drop("inputs")


@query(
    "feature_windows",
    """WITH f AS (SELECT user_id, row_number() OVER w - 1 AS start, array_agg(value * 100 + event_id % 10) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x,
      lead(value, 4) OVER w AS target FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT user_id, start, round(list_sum(x), 3) AS mixed, target FROM f WHERE target IS NOT NULL""",
)
def q_feature_windows(spark, sf_dir):
    df = event_series(spark, sf_dir)
    pair = F.struct(F.col("value"), (F.col("event_id") % 10).cast("double").alias("digit"), F.col("value").alias("y"))
    out = sequence.sliding_windows(df, ["user_id"], ["ts", "event_id"], pair, 4, 1)
    mixed = F.aggregate("inputs", F.lit(0.0), lambda a, s: a + s["value"] * 100 + s["digit"])
    return rounded(out.select("user_id", "start", mixed.alias("mixed"), F.col("target.y").alias("target")), "mixed", digits=3)


@query(
    "horizon_band",
    f"""WITH {SERIES}, r AS (SELECT unnest([0, 1, 2]) AS step, unnest(list_transform(targets, lambda v: inputs[5] - v)) AS residual FROM s WHERE len(targets) = 3)
    SELECT step, round(stddev_pop(residual), 6) AS std, round(1.96 * stddev_pop(residual), 6) AS band, count(*) AS n FROM r GROUP BY step""",
)
def q_band(spark, sf_dir):
    out = sequence.multi_horizon(event_series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 5, 3)
    guess = out.withColumn("predicted", F.array_repeat(F.element_at("inputs", 5), 3))
    return rounded(sequence.horizon_band(guess, "predicted", "targets"), "std", "band")


@query(
    "standardized_series",
    """SELECT event_id, round((value - avg(value) OVER u) / CASE WHEN stddev_pop(value) OVER u = 0 THEN 1 ELSE stddev_pop(value) OVER u END, 6) + 0.0 AS scaled FROM events WINDOW u AS (PARTITION BY user_id)""",
)
def q_standardized(spark, sf_dir):
    out = sequence.standardize_series(event_series(spark, sf_dir), ["user_id"], "value")
    return rounded(out, "scaled").select("event_id", "scaled")


@query("autoregression_baselines")
def q_baselines(spark, sf_dir):
    return sequence.baseline_comparison(event_series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 5)


@query(
    "naive_baselines",
    """WITH l AS (SELECT value AS y, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (SELECT 'last value' AS model, l1 - y AS e FROM l WHERE l3 IS NOT NULL UNION ALL SELECT 'window mean', (l1 + l2 + l3) / 3 - y FROM l WHERE l3 IS NOT NULL)
    SELECT model, round(avg(e * e), 4) AS mse, round(avg(abs(e)), 6) AS mae, count(*) AS n FROM e GROUP BY model""",
)
def q_naive(spark, sf_dir):
    out = sequence.baseline_comparison(event_series(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", 3)
    return rounded(rounded(out.where(F.col("model") != "autoregression"), "mse", digits=4), "mae")


@query("recursive_forecast")
def q_recursive(spark, sf_dir):
    df = event_series(spark, sf_dir)
    w, b = sequence.fit_autoregression(df, ["user_id"], ["ts", "event_id"], "value", 5)
    return sequence.recursive_forecast(df, ["user_id"], ["ts", "event_id"], "value", w, b, 10)


@query(
    "trim_history",
    """WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    p AS (SELECT conv_id, n, 0::BIGINT AS pos FROM m WHERE i = 0
          UNION ALL SELECT p.conv_id, p.n, p.pos + CASE WHEN m.role = 'user' THEN 2 ELSE 1 END FROM p JOIN m ON m.conv_id = p.conv_id AND m.i = p.pos WHERE p.n - p.pos > 4),
    f AS (SELECT conv_id, max(pos) AS pos FROM p GROUP BY conv_id)
    SELECT m.conv_id, m.turn, m.role, m.text FROM m JOIN f ON m.conv_id = f.conv_id WHERE m.i >= f.pos""",
)
def q_trim(spark, sf_dir):
    return chatlog.trim_history(table(spark, sf_dir, "conversations"), 2)


@query(
    "context_string",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
    SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) AS context FROM r WHERE r <= 4 GROUP BY conv_id""",
)
def q_context(spark, sf_dir):
    return chatlog.context_string(table(spark, sf_dir, "conversations"), 2)


@query("last_assistant", "SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def q_last(spark, sf_dir):
    return chatlog.last_assistant(table(spark, sf_dir, "conversations"))


def any_sql(phrases):
    return "(" + " OR ".join(f"contains(q, '{p}')" for p in phrases) + ")"


# Real questions are rare in the generated text: half of the user messages get one of the rule words appended.
QUESTION_SQL = """CASE conv_id % 12 WHEN 1 THEN text || ' which target?' WHEN 2 THEN text || ' correlation' WHEN 3 THEN text || ' predictor' WHEN 4 THEN 'Why ' || text
  WHEN 5 THEN text || ' better than' WHEN 6 THEN 'I should ' || text WHEN 7 THEN text || ' worst' WHEN 8 THEN text || ' how many' WHEN 9 THEN text || ' is this, then?' ELSE text END"""


def question_text():
    t, c = F.col("text"), F.col("conv_id") % 12
    return (
        F.when(c == 1, F.concat(t, F.lit(" which target?")))
        .when(c == 2, F.concat(t, F.lit(" correlation")))
        .when(c == 3, F.concat(t, F.lit(" predictor")))
        .when(c == 4, F.concat(F.lit("Why "), t))
        .when(c == 5, F.concat(t, F.lit(" better than")))
        .when(c == 6, F.concat(F.lit("I should "), t))
        .when(c == 7, F.concat(t, F.lit(" worst")))
        .when(c == 8, F.concat(t, F.lit(" how many")))
        .when(c == 9, F.concat(t, F.lit(" is this, then?")))
        .otherwise(t)
    )


@query(
    "classify_question",
    f"""WITH u AS (SELECT conv_id, turn, lower(trim({QUESTION_SQL})) AS q FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN {any_sql(chatlog.TARGET_SELECTION)} THEN 'target_selection' WHEN {any_sql(chatlog.DIAGNOSTIC)} THEN 'computation'
      WHEN {any_sql(chatlog.FEATURE_IMPORTANCE)} THEN 'feature_importance'
      WHEN ({' OR '.join(f"starts_with(q, '{p}')" for p in chatlog.FOLLOW_UP_STARTS)}) OR (regexp_matches(q, '(^|[\\s?,])(that|it|this)([\\s?,]|$)') AND NOT {any_sql(chatlog.RECOMMENDATION)}) THEN 'follow_up'
      WHEN {any_sql(chatlog.COMPARISON)} THEN 'comparison' WHEN {any_sql(chatlog.RECOMMENDATION)} THEN 'recommendation'
      WHEN {any_sql(chatlog.MODEL_PERFORMANCE)} THEN 'model_performance' WHEN {any_sql(chatlog.DATASET_STATS)} THEN 'dataset_stats' ELSE 'general' END AS question_type FROM u""",
)
def q_classify(spark, sf_dir):
    users = chatlog.user_questions(table(spark, sf_dir, "conversations"))
    return users.select("conv_id", "turn", chatlog.question_type(question_text()).alias("question_type"))


PAIRS_SQL = """t AS (SELECT *, (conv_id + turn) % 3 <> 0 AS grounded, lag(role) OVER w AS prev_role, lag(turn) OVER w AS question_turn, lag(text) OVER w AS question
    FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  pairs AS (SELECT conv_id, question_turn, question, turn AS answer_turn, text AS answer FROM t WHERE role = 'assistant' AND prev_role = 'user' AND grounded)"""


def grounded():
    return (F.col("conv_id") + F.col("turn")) % 3 != 0


@query("qa_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def q_pairs(spark, sf_dir):
    return chatlog.qa_pairs(table(spark, sf_dir, "conversations"), grounded())


@query(
    "grounded_explanations",
    """WITH k AS (SELECT *, lag(role) OVER w AS pr, lag(turn) OVER w AS pt, lag(text) OVER w AS px FROM conversations
       WHERE role = 'user' OR (role = 'assistant' AND (conv_id + turn) % 3 <> 0) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, CASE WHEN pr = 'user' THEN pt END AS question_turn, CASE WHEN pr = 'user' THEN px END AS question, turn AS answer_turn, text AS answer FROM k WHERE role = 'assistant'""",
)
def q_grounded(spark, sf_dir):
    return chatlog.grounded_explanations(table(spark, sf_dir, "conversations"), grounded())


TOPIC_SQL = " OR ".join(f"contains(lower(question || ' ' || answer), '{t}')" for t in chatlog.TOPICS)


@query(
    "notable_pairs",
    f"""WITH {PAIRS_SQL}, r AS (SELECT conv_id, question_turn, answer_turn, row_number() OVER (PARTITION BY conv_id ORDER BY (answer_turn % 4 = 1)::INTEGER DESC, ({TOPIC_SQL})::INTEGER DESC, answer_turn DESC) AS pick FROM pairs)
    SELECT conv_id, question_turn, answer_turn, pick::INTEGER AS pick FROM r WHERE pick <= 2""",
)
def q_notable(spark, sf_dir):
    pairs = chatlog.qa_pairs(table(spark, sf_dir, "conversations"), grounded())
    return chatlog.notable_pairs(pairs, F.col("answer_turn") % 4 == 1, 2).select("conv_id", "question_turn", "answer_turn", "pick")


def words_sql(c):
    return f"CASE WHEN trim({c}, E' \\n\\t\\r') = '' THEN 0 ELSE len(regexp_split_to_array(trim({c}, E' \\n\\t\\r'), '\\s+')) END"


@query(
    "token_usage",
    f"""WITH {PAIRS_SQL}, c AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'local' END AS model,
      CAST(round_even(({words_sql('question')}) * 1.3::DOUBLE, 0) AS BIGINT) AS i, CAST(round_even(({words_sql('answer')}) * 1.3::DOUBLE, 0) AS BIGINT) AS o FROM pairs)
    SELECT model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
      round(sum(i * CASE model WHEN 'gpt-4o' THEN 0.005::DOUBLE WHEN 'gpt-4o-mini' THEN 0.00015::DOUBLE ELSE 0 END + o * CASE model WHEN 'gpt-4o' THEN 0.015::DOUBLE WHEN 'gpt-4o-mini' THEN 0.0006::DOUBLE ELSE 0 END) / 1000, 6) AS estimated_cost_usd
    FROM c GROUP BY model""",
)
def q_usage(spark, sf_dir):
    pairs = chatlog.qa_pairs(table(spark, sf_dir, "conversations"), grounded())
    model = F.get(F.array(F.lit("gpt-4o"), F.lit("gpt-4o-mini"), F.lit("local")), (F.col("conv_id") % 3).cast("int"))
    return rounded(chatlog.token_usage(pairs.withColumn("model", model), "question", "answer", "model"), "estimated_cost_usd")
