"""Curation of conversation tables ``conv_id, turn, role, text``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbrule.core.ordering import neighbour_chunks
from plumbrule.functions.columns import word_count

CONV, TURN = "conv_id", "turn"

# Phrases that decide the type of a question.
TARGET_SELECTION = (
    "best target", "target column", "which target", "recommended target", "choose as the target", "choose as target", "predict column",
)
DIAGNOSTIC = (
    "feature importance", "importance", "complexity", "correlation", "mutual information", "overfit", "overfitting", "leakage", "gap",
    "best model", "model selection", "compact", "missing", "duplicates",
)
ACTION = (
    "compute", "calculate", "run", "investigate", "analysis", "analyze", "do it", "do this", "do that", "please do", "can you do",
)
FEATURE_IMPORTANCE = ("feature", "important", "relevant", "mutual information", "mutual", "which column", "variable", "predictor")
FOLLOW_UP_STARTS = ("why", "how so", "what about", "can you", "tell me more", "explain", "elaborate")
PRONOUNS = ("that", "it", "this")
RECOMMENDATION = ("should i", "should", "recommend", "suggest", "what would you", "would you", "how should", "what is the best way")
COMPARISON = ("vs", "versus", "compare", "difference between", "difference", "better than", "worse than", "which is")
MODEL_PERFORMANCE = ("accuracy", "f1", "score", "model", "performance", "best", "worst", "result", "prediction", "classify")
DATASET_STATS = ("how many", "rows", "columns", "missing", "type", "shape", "size", "duplicate", "null")
TOPICS = ("model", "performance", "accuracy", "score", "overfit", "feature", "importance", "predictor")

# US dollars per 1000 input and output tokens.
PRICES = {
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o": (0.005, 0.015),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "claude-haiku-4-5-20251001": (0.00025, 0.00125),
    "claude-sonnet-4-6": (0.003, 0.015),
}


def has_any(text: Column, phrases: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | text.contains(p)
    return hit


def wants_computation(question: Column, previous_answer: Column | None = None) -> Column:
    """The question names a diagnostic, or asks for action on one named in the previous answer."""
    q = F.lower(question)
    named = has_any(q, DIAGNOSTIC)
    if previous_answer is None:
        return named
    return named | (has_any(q, ACTION) & has_any(F.lower(F.coalesce(previous_answer, F.lit(""))), DIAGNOSTIC))


def question_type(question: Column) -> Column:
    """Type of a question by the first matching rule."""
    q = F.lower(F.trim(question))
    words = F.split(F.regexp_replace(F.regexp_replace(q, "[?,]", " "), r"\s+", " "), " ")
    pronoun = F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS)))
    starts = F.lit(False)
    for s in FOLLOW_UP_STARTS:
        starts = starts | q.startswith(s)
    advice = has_any(q, RECOMMENDATION)
    return (
        F.when(has_any(q, TARGET_SELECTION), "target_selection")
        .when(wants_computation(q), "computation")
        .when(has_any(q, FEATURE_IMPORTANCE), "feature_importance")
        .when(starts | (pronoun & ~advice), "follow_up")
        .when(has_any(q, COMPARISON), "comparison")
        .when(advice, "recommendation")
        .when(has_any(q, MODEL_PERFORMANCE), "model_performance")
        .when(has_any(q, DATASET_STATS), "dataset_stats")
        .otherwise("general")
    )


def latest(df: DataFrame, count: int) -> DataFrame:
    """The last ``count`` messages per conversation; Spark cuts each group before the shuffle."""
    w = Window.partitionBy(CONV).orderBy(F.desc(TURN))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count)


def trim_history(df: DataFrame, max_turns: int) -> DataFrame:
    """Keep the last messages of a bounded history.

    From the front, a user message leaves together with the message after it, any other message alone, until at
    most ``2 * max_turns`` (at least 2) are left.  So the cut falls on the limit, or one message later when
    the last removed pair straddles it.  Whether it does depends on how the front messages pair up: inside
    a run of user messages pairs are taken two by two.
    """
    limit = max(2 * max_turns, 2)
    sizes = df.groupBy(CONV).agg(F.count(F.lit(1)).alias("_size"))
    chunks, w = neighbour_chunks(df.select(CONV, TURN, "role"), [TURN], [CONV], before=1)
    # A message starts a fresh removal step for certain when the message before it is not a user message.
    sure = F.coalesce(F.lag("role").over(w) != "user", F.lit(True))
    marks = chunks.withColumn("_sure", sure).where("_own").join(sizes, CONV)
    first_kept = F.col("_size") - limit
    # the last certain step start at or before the limit decides the parity of the pairs after it
    anchor = marks.groupBy(CONV).agg(
        F.max(F.when(F.col("_sure") & (F.col("_idx") <= first_kept), F.col("_idx"))).alias("_anchor"),
        F.max("_size").alias("_size"),
    )
    start = F.when(F.col("_size") <= limit, F.lit(0)).otherwise(first_kept + F.pmod(first_kept - F.coalesce("_anchor", F.lit(0)), F.lit(2)))
    cut = anchor.select(CONV, (F.col("_size") - start).alias("_keep"))
    kept = latest(df, limit).join(cut, CONV)
    return kept.where(F.col("_r") <= F.col("_keep")).drop("_r", "_keep")


def context_string(df: DataFrame, exchanges: int = 6) -> DataFrame:
    """The last ``2 * exchanges`` messages per conversation as ``Role: text`` lines."""
    recent = latest(df, 2 * exchanges)
    line = F.concat(F.initcap("role"), F.lit(": "), F.col("text"))
    lines = F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("k"), line.alias("line"))))
    return recent.groupBy(CONV).agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("context"))


def last_assistant(df: DataFrame) -> DataFrame:
    """Last assistant message of each conversation that has one."""
    last = F.max_by(F.struct(TURN, "text"), TURN)
    return df.where(F.col("role") == "assistant").groupBy(CONV).agg(last.alias("m")).select(CONV, f"m.{TURN}", "m.text")


def user_questions(df: DataFrame) -> DataFrame:
    return df.where(F.col("role") == "user")


def _adjacent(df: DataFrame) -> DataFrame:
    """Each assistant message with the message right before it, if that is a user message."""
    chunks, w = neighbour_chunks(df, [TURN], [CONV], before=1)
    prev = F.lag(F.struct("role", TURN, "text")).over(w)
    out = chunks.withColumn("_prev", prev).where(F.col("_own") & (F.col("role") == "assistant"))
    asked = F.when(F.col("_prev.role") == "user", F.col("_prev"))
    return out.withColumns({"question": asked["text"], "question_turn": asked[TURN]}).drop("_prev", "_own", "_chunk", "_idx")


def qa_pairs(df: DataFrame, grounded: Column) -> DataFrame:
    """Latest user message paired with the next assistant reply; any reply uses the question up, and the
    pair is kept if the reply is grounded."""
    talk = df.where(F.col("role").isin("user", "assistant")).withColumn("grounded", grounded)
    pairs = _adjacent(talk).where(F.col("question").isNotNull() & F.col("grounded"))
    return pairs.select(CONV, "question_turn", "question", F.col(TURN).alias("answer_turn"), F.col("text").alias("answer"), *_extra(df))


def grounded_explanations(df: DataFrame, grounded: Column) -> DataFrame:
    """Grounded assistant messages with the pending question; ungrounded replies leave the question pending."""
    talk = df.where((F.col("role") == "user") | ((F.col("role") == "assistant") & grounded))
    return _adjacent(talk).select(CONV, "question_turn", "question", F.col(TURN).alias("answer_turn"), F.col("text").alias("answer"), *_extra(df))


def _extra(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (CONV, TURN, "role", "text")]


def notable_pairs(pairs: DataFrame, deterministic: Column, count: int = 5) -> DataFrame:
    """Up to ``count`` pairs per conversation: deterministic source first, then on-topic, then latest."""
    text = F.lower(F.concat_ws(" ", "question", "answer"))
    ranked = pairs.withColumns({"_d": deterministic.cast("int"), "_t": has_any(text, TOPICS).cast("int")})
    w = Window.partitionBy(CONV).orderBy(F.desc("_d"), F.desc("_t"), F.desc("answer_turn"))
    best = ranked.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= count)
    return best.drop("_d", "_t").orderBy(CONV, "question_turn")


def estimated_tokens(text: str | Column) -> Column:
    """Words times 1.3, rounded half to even."""
    return F.bround(word_count(text) * F.lit(1.3), 0).cast("long")


def token_usage(calls: DataFrame, prompt: str, response: str, model: str, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Calls, tokens and estimated cost per model; unknown models cost nothing."""
    prices = PRICES if prices is None else prices
    rate_in = F.create_map(*[F.lit(x) for m, (a, _) in prices.items() for x in (m, a)])
    rate_out = F.create_map(*[F.lit(x) for m, (_, b) in prices.items() for x in (m, b)])
    cost = (
        F.col("input_tokens") * F.coalesce(F.try_element_at(rate_in, F.col(model)), F.lit(0.0))
        + F.col("output_tokens") * F.coalesce(F.try_element_at(rate_out, F.col(model)), F.lit(0.0))
    ) / 1000.0
    counted = calls.select(F.col(model), estimated_tokens(prompt).alias("input_tokens"), estimated_tokens(response).alias("output_tokens"))
    return counted.groupBy(model).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(cost).alias("estimated_cost_usd"),
    )
