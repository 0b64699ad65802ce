"""Exploration, preprocessing and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbrule.functions import columns as fx
from plumbrule.operators import explore, prep, split
from plumbrule.plans.associations import rounded
from plumbrule.plans.profiling import CUSTOMER_SQL, customer_with_holes
from plumbrule.plans.registry import query, table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "class_balance",
    """SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1""",
)
def q_balance(spark, sf_dir):
    return rounded(explore.class_balance(table(spark, sf_dir, "orders"), "o_orderpriority"), "share")


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS low,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c})::DOUBLE AS high FROM lineitem"""
        for c in LINE_NUMBERS
    ),
)
def q_describe(spark, sf_dir):
    out = explore.describe_numeric(table(spark, sf_dir, "lineitem"), LINE_NUMBERS)
    return rounded(out, "mean", "std", "q25", "q50", "q75", digits=4)


@query(
    "describe_text",
    """WITH h AS (SELECT c_mktsegment AS v FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer)),
       c AS (SELECT v, count(*) AS n FROM h WHERE v IS NOT NULL GROUP BY v)
       SELECT 'c_mktsegment' AS "column", CAST(sum(n) AS BIGINT) AS n, count(*) AS "unique", (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS top, max(n) AS freq FROM c""",
)
def q_describe_text(spark, sf_dir):
    return explore.describe_text(customer_with_holes(spark, sf_dir), ["c_mktsegment"])


@query(
    "crosstab",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
       count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""",
)
def q_crosstab(spark, sf_dir):
    return explore.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query(
    "class_histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 25 AS w FROM lineitem)
       SELECT l_returnflag, least(floor((l_extendedprice - lo) / w), 24)::INTEGER AS bin, count(*) AS n FROM lineitem, e GROUP BY ALL""",
)
def q_histogram(spark, sf_dir):
    return explore.class_histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 25)


def box_sql(c):
    return f"""SELECT l_returnflag, '{c}' AS "column", round(max(q[1]), 4) AS q25, round(max(q[2]), 4) AS q50, round(max(q[3]), 4) AS q75,
      min({c}) FILTER ({c} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]))::DOUBLE AS whisker_low,
      max({c}) FILTER ({c} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]))::DOUBLE AS whisker_high,
      count(*) FILTER (NOT {c} BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1])) AS outliers
      FROM lineitem JOIN (SELECT l_returnflag, quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1"""


@query("class_boxplot", f"{box_sql('l_extendedprice')} UNION ALL {box_sql('l_quantity')}")
def q_boxplot(spark, sf_dir):
    out = explore.class_boxplot(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_extendedprice", "l_quantity"])
    return rounded(out, "q25", "q50", "q75", digits=4)


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in LINE_NUMBERS for b in LINE_NUMBERS
    ),
)
def q_correlation(spark, sf_dir):
    return rounded(explore.correlation_matrix(table(spark, sf_dir, "lineitem"), LINE_NUMBERS), "correlation")


@query(
    "correlation_matrix_missing",
    "WITH m AS (SELECT l_quantity AS a, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS b, CASE WHEN l_orderkey % 7 < 6 THEN NULL ELSE l_discount END AS c FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM m" for a in "abc" for b in "abc"),
)
def q_correlation_missing(spark, sf_dir):
    lines, key = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    df = lines.select(F.col("l_quantity").alias("a"), F.when(key % 5 != 0, F.col("l_extendedprice")).alias("b"), F.when(key % 7 >= 6, F.col("l_discount")).alias("c"))
    return rounded(explore.correlation_matrix(df, ["a", "b", "c"]), "correlation")


@query(
    "class_kde",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
       c AS (SELECT event_type, count(*) AS size, greatest(CASE WHEN stddev_samp(value) > 0 THEN 1.06::DOUBLE * stddev_samp(value) * pow(count(*), -0.2::DOUBLE) ELSE 1 END, 1e-6) AS h
             FROM events GROUP BY 1),
       v AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL)
       SELECT event_type AS label, step::INTEGER AS step, round(max(lo + step * ((hi - lo) / 199)), 6) AS at,
         round(sum(n * exp(-0.5 * pow((lo + step * ((hi - lo) / 199) - value) / h, 2))) / max(size) / (max(h) * sqrt(2 * pi())), 6) AS density
       FROM v JOIN c USING (event_type), e, range(0, 200) AS g(step) GROUP BY event_type, step""",
)
def q_kde(spark, sf_dir):
    return rounded(explore.class_kde(table(spark, sf_dir, "events"), "event_type", "value"), "at", "density")


@query(
    "skew_notes",
    "SELECT feature, round(skewness, 6) AS skewness, CASE WHEN abs(skewness) < 0.5 THEN 'approximately Gaussian' ELSE 'skewed' END AS note FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, skewness({c}) AS skewness FROM {t}" for c, t in (("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"), ("l_discount", "lineitem")))
    + ")",
)
def q_skew(spark, sf_dir):
    return rounded(explore.skew_notes(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "skewness")


@query(
    "class_moments",
    " UNION ALL ".join(
        f"""SELECT l_returnflag AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS prior, '{c}' AS feature,
        round(avg({c}), 4) AS mean, round(var_pop({c}), 3) AS variance FROM lineitem GROUP BY l_returnflag"""
        for c in ("l_quantity", "l_discount")
    ),
)
def q_class_moments(spark, sf_dir):
    out = explore.class_moments(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"])
    return rounded(rounded(rounded(out, "prior"), "mean", digits=4), "variance", digits=3)


@query(
    "metric_minmax",
    """WITH m AS (SELECT event_type AS model, avg(value) AS score, stddev_pop(value) AS spread, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY 1)
       SELECT model, round((score - min(score) OVER ()) / CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE max(score) OVER () - min(score) OVER () END, 6) AS score,
         round(1 - (spread - min(spread) OVER ()) / CASE WHEN max(spread) OVER () = min(spread) OVER () THEN 1 ELSE max(spread) OVER () - min(spread) OVER () END, 6) AS spread,
         round((users - min(users) OVER ()) / CASE WHEN max(users) OVER () = min(users) OVER () THEN 1 ELSE max(users) OVER () - min(users) OVER () END, 6) AS users FROM m""",
)
def q_minmax(spark, sf_dir):
    m = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("model"))
        .agg(F.avg("value").alias("score"), F.stddev_pop("value").alias("spread"), F.count_distinct("user_id").cast("double").alias("users"))
    )
    return rounded(explore.metric_minmax(m, "model", ["score", "spread", "users"], ["spread"]), "score", "spread", "users")


@query(
    "run_summary",
    """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, max(value) AS high,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY 1""",
)
def q_run_summary(spark, sf_dir):
    out = explore.run_summary(table(spark, sf_dir, "events"), "event_type", "value")
    return rounded(out, "mean", "std", "q25", "q50", "q75")


# preprocessing


@query(
    "impute_median",
    f"""WITH {CUSTOMER_SQL}, m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer_h)
        SELECT c_custkey, round(coalesce(c_acctbal, m), 6) AS c_acctbal FROM customer_h, m""",
)
def q_impute_median(spark, sf_dir):
    df = customer_with_holes(spark, sf_dir).select("c_custkey", "c_acctbal")
    return rounded(prep.impute_median(df, ["c_acctbal"]), "c_acctbal")


@query(
    "impute_mode",
    f"""WITH {CUSTOMER_SQL}, m AS (SELECT c_mktsegment AS m FROM customer_h WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT c_custkey, coalesce(c_mktsegment, m) AS c_mktsegment FROM customer_h, m""",
)
def q_impute_mode(spark, sf_dir):
    return prep.impute_mode(customer_with_holes(spark, sf_dir).select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query(
    "standard_scale",
    """WITH m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice - a) / s, 6) + 0.0 AS o_totalprice FROM orders, m""",
)
def q_scale(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(prep.standard_scale(df, ["o_totalprice"]), "o_totalprice")


@query(
    "one_hot",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS o_orderstatus_f, (o_orderstatus = 'O')::INTEGER AS o_orderstatus_o,
       (o_orderstatus = 'P')::INTEGER AS o_orderstatus_p FROM orders""",
)
def q_one_hot(spark, sf_dir):
    return prep.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query(
    "label_encode",
    f"""WITH {CUSTOMER_SQL} SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment IS NOT NULL THEN dense_rank() OVER (ORDER BY c_mktsegment NULLS LAST) - 1 END AS code FROM customer_h""",
)
def q_label_encode(spark, sf_dir):
    return prep.label_encode(customer_with_holes(spark, sf_dir).select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query(
    "engineered_ratios",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_returnflag = 'R')::DOUBLE AS is_returned, round(l_extendedprice / greatest(l_quantity, 1), 8) AS price_per_unit,
       round(l_discount / greatest(l_tax, 1), 8) AS discount_per_tax, round(l_quantity / greatest(l_linenumber, 1), 8) AS quantity_per_line FROM lineitem""",
)
def q_ratios(spark, sf_dir):
    df = prep.indicator(table(spark, sf_dir, "lineitem"), "l_returnflag", "R", "is_returned")
    out = prep.ratio_features(
        df,
        {
            "price_per_unit": ("l_extendedprice", "l_quantity"),
            "discount_per_tax": ("l_discount", "l_tax"),
            "quantity_per_line": ("l_quantity", "l_linenumber"),
        },
    )
    names = ["price_per_unit", "discount_per_tax", "quantity_per_line"]
    return rounded(out, *names, digits=8).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "is_returned", *names)


@query(
    "poly_features",
    """SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y, round(p_size::DOUBLE * p_size, 4) AS x__x, round(p_size * p_retailprice, 4) AS x__y,
       round(p_retailprice * p_retailprice, 4) AS y__y FROM part""",
)
def q_poly(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return rounded(prep.poly_features(df, ["x", "y"], 2), "x__x", "x__y", "y__y", digits=4)


STOP = ("the", "and", "of", "to", "in", "is", "it", "that", "for", "on", "with", "as", "at", "by", "an", "be")
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
TOKENS_SQL = f"""tok AS (SELECT doc_id, lang, token FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM documents)
   WHERE token NOT IN ({STOP_SQL}))"""


@query("token_counts", f"WITH {TOKENS_SQL} SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 5000")
def q_tokens(spark, sf_dir):
    return prep.vocabulary(table(spark, sf_dir, "documents"), "text", STOP, 5000)


@query("fourier_features")
def q_fourier(spark, sf_dir):
    df = prep.standard_scale(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return prep.fourier_features(df, ["p_size", "p_retailprice"], 50)


# splits

ORDERED = """ord AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) - 1 AS i,
   count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")


@query("stratified_split", f"WITH {ORDERED} SELECT o_orderkey, o_orderpriority, i < ceil(n * 0.2::DOUBLE - 1e-9) AS is_test FROM ord")
def q_split(spark, sf_dir):
    return split.stratified_split(labelled(spark, sf_dir), "o_orderpriority", ["o_orderkey"], modular=True)


@query("stratified_folds", f"WITH {ORDERED} SELECT o_orderkey, o_orderpriority, (i % 5)::INTEGER AS fold FROM ord")
def q_folds(spark, sf_dir):
    return split.stratified_folds(labelled(spark, sf_dir), "o_orderpriority", ["o_orderkey"], modular=True)


@query("hashed_split")
def q_hashed_split(spark, sf_dir):
    return split.stratified_split(labelled(spark, sf_dir), "o_orderpriority", ["o_orderkey"]).groupBy("o_orderpriority", "is_test").count()


@query(
    "safe_cv_splits",
    """SELECT count(*) AS n_classes, min(n) AS min_class, greatest(2, least(5, min(n))) AS folds FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)""",
)
def q_safe_folds(spark, sf_dir):
    return split.safe_cv_splits(table(spark, sf_dir, "orders"), "o_orderstatus")


@query(
    "learning_subset_counts",
    f"""WITH {ORDERED}, f AS (SELECT *, i % 5 AS fold FROM ord),
       t AS (SELECT f.*, h AS held_out, row_number() OVER (PARTITION BY h, o_orderpriority ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) - 1 AS j,
               count(*) OVER (PARTITION BY h, o_orderpriority) AS m FROM f, range(0, 5) AS r(h) WHERE fold <> h)
       SELECT held_out::INTEGER AS held_out, fraction, count(*) AS n_train FROM t, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS fraction)
       WHERE j < ceil(m * fraction - 1e-9) GROUP BY ALL""",
)
def q_learning(spark, sf_dir):
    return split.learning_subset_counts(labelled(spark, sf_dir), "o_orderpriority", ["o_orderkey"], [0.1, 0.25, 0.5, 0.75, 1.0], modular=True)


@query(
    "chrono_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, CASE WHEN i < floor(n * 0.7::DOUBLE + 1e-9) THEN 'train' WHEN i < floor(n * 0.85::DOUBLE + 1e-9) THEN 'validation' ELSE 'test' END AS part FROM r""",
)
def q_chrono(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return split.chrono_split(df, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "part")


@query("bootstrap_weights")
def q_bootstrap(spark, sf_dir):
    out = split.bootstrap_weights(labelled(spark, sf_dir), ["o_orderkey"], 5)
    return out.groupBy("estimator").agg(F.sum("weight").alias("drawn"), F.count_if(F.col("weight") == 0).alias("out_of_bag"))


# column functions


@query(
    "activation_columns",
    """WITH v AS (SELECT event_id, (value - 50) / 50 AS x FROM events)
       SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh, round(greatest(x, 0), 6) AS relu,
         round(CASE WHEN x > 0 THEN x ELSE 0.01::DOUBLE * x END, 6) + 0.0 AS leaky_relu, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) + 0.0 AS elu,
         round(sign(x) * greatest(abs(x) - 0.5, 0), 6) + 0.0 AS soft_threshold FROM v""",
)
def q_activations(spark, sf_dir):
    x = (F.col("value") - 50) / 50
    out = table(spark, sf_dir, "events").select(
        "event_id",
        fx.sigmoid(x).alias("sigmoid"),
        F.tanh(x).alias("tanh"),
        fx.relu(x).alias("relu"),
        fx.leaky_relu(x).alias("leaky_relu"),
        fx.elu(x).alias("elu"),
        fx.soft_threshold(x, 0.5).alias("soft_threshold"),
    )
    return rounded(out, "sigmoid", "tanh", "relu", "leaky_relu", "elu", "soft_threshold")


SCORES_SQL = "s AS (SELECT p_partkey, [p_size / 10.0::DOUBLE, p_retailprice / 500, (p_partkey % 13)::DOUBLE / 3] AS z FROM part)"


def part_scores(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 500, (F.col("p_partkey") % 13).cast("double") / 3).alias("z"),
    )


@query(
    "softmax_columns",
    f"""WITH {SCORES_SQL}, m AS (SELECT *, list_max(z) AS m FROM s), e AS (SELECT p_partkey, m, list_transform(z, lambda v: exp(v - m)) AS e FROM m)
       SELECT p_partkey, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2, round(m + ln(list_sum(e)), 6) AS lse FROM e""",
)
def q_softmax(spark, sf_dir):
    df = part_scores(spark, sf_dir).withColumn("p", fx.softmax("z")).withColumn("lse", fx.log_sum_exp("z"))
    out = df.select("p_partkey", *[F.col("p")[i].alias(f"p{i}") for i in range(3)], "lse")
    return rounded(out, "p0", "p1", "p2", "lse")


@query("argmax_class", f"WITH {SCORES_SQL} SELECT p_partkey, ['small', 'middle', 'large'][list_position(z, list_max(z))] AS class FROM s")
def q_argmax(spark, sf_dir):
    return part_scores(spark, sf_dir).select("p_partkey", fx.argmax_label("z", ["small", "middle", "large"]).alias("class"))


@query(
    "prob_map",
    f"""WITH {SCORES_SQL}, n AS (SELECT p_partkey, list_transform(z, lambda v: v / list_sum(z)) AS p FROM s)
       SELECT p_partkey, 'k' || (list_position(p, list_max(p)) - 1) AS class, round(p[1], 6) AS small, round(p[2], 6) AS middle, round(p[3], 6) AS large, 3 AS entries FROM n""",
)
def q_prob_map(spark, sf_dir):
    df = part_scores(spark, sf_dir).withColumn("p", fx.normalized("z"))
    out = df.withColumn("record", fx.prediction("p", ["k0", "k1", "k2"]))
    m = F.col("record.probabilities")
    out = out.select(
        "p_partkey", F.col("record.class").alias("class"), m["k0"].alias("small"), m["k1"].alias("middle"), m["k2"].alias("large"), F.size(m).alias("entries")
    )
    return rounded(out, "small", "middle", "large")


@query(
    "safe_token",
    """SELECT p_brand, p_type, trim(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS token, count(*) AS n FROM part GROUP BY ALL""",
)
def q_safe_token(spark, sf_dir):
    label = F.concat_ws(" / ", "p_brand", "p_type")
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type", fx.safe_token(label).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("event_props", """SELECT event_type, count(*) AS n, sum(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY 1""")
def q_props(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum"))
