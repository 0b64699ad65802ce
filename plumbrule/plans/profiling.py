"""Cleaning, profiling, suggestion and schema-rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbrule.operators import clean, profile, schema_rules
from plumbrule.plans.registry import query, table

# customer with holes: the given tables have no missing values
CUSTOMER_SQL = """
customer_h AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""


def customer_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        "c_nationkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


PART_COLUMNS = {
    "p_partkey": ("bigint", True),
    "p_name": ("string", False),
    "p_brand": ("string", False),
    "p_type": ("string", False),
    "p_size": ("int", True),
    "p_retailprice": ("double", True),
}


def stats_sql(source: str, columns: dict[str, tuple[str, bool]]) -> str:
    """SQL text of the per-column statistics that the rules are applied to."""
    parts = []
    for i, (c, (dtype, number)) in enumerate(columns.items()):
        num = f"{c}::DOUBLE" if number else "NULL::DOUBLE"
        parts.append(
            f"""SELECT {i} AS position, '{c}' AS "column", '{dtype}' AS dtype, {str(number).upper()} AS is_number,
  {str(dtype == "string").upper()} AS is_text, count(*) AS n_rows, count({c}) AS present, count(DISTINCT {c}) AS uniq,
  count(*) - count({c}) AS missing, avg({num}) AS mu, stddev_pop({num}) AS sd, min({num}) AS lo, max({num}) AS hi,
  CAST(min({c}) AS VARCHAR) AS example,
  (SELECT min(k) FROM (SELECT count(*) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})) AS min_count
FROM {source}"""
        )
    return "stats AS (" + "\nUNION ALL\n".join(parts) + ")"


CUSTOMER_COLUMNS = {
    "c_custkey": ("bigint", True),
    "c_name": ("string", False),
    "c_nationkey": ("int", True),
    "c_acctbal": ("double", True),
    "c_mktsegment": ("string", False),
}
CUSTOMER_STATS = f"WITH {CUSTOMER_SQL}, {stats_sql('customer_h', CUSTOMER_COLUMNS)}"
ORDERS_COLUMNS = {
    "o_custkey": ("bigint", True),
    "o_orderstatus": ("string", False),
    "o_totalprice": ("double", True),
    "o_orderpriority": ("string", False),
}
ORDERS_STATS = f"WITH {stats_sql('orders', ORDERS_COLUMNS)}"


@query(
    "clean_dataframe",
    """SELECT c_custkey_h, c_acctbal_h, c_mktsegment_h FROM (
         SELECT CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey END AS c_custkey_h,
                CASE WHEN c_custkey % 6 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal_h,
                CASE WHEN c_custkey % 6 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment_h
         FROM customer)
       WHERE coalesce(CAST(c_custkey_h AS VARCHAR), CAST(c_acctbal_h AS VARCHAR), c_mktsegment_h) IS NOT NULL""",
)
def q_clean(spark, sf_dir):
    key = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(
        F.when(key % 6 != 0, key).alias("c_custkey_h"),
        F.when((key % 6 != 0) & (key % 7 != 0), F.col("c_acctbal")).alias("c_acctbal_h"),
        F.when((key % 6 != 0) & (key % 5 != 0), F.col("c_mktsegment")).alias("c_mktsegment_h"),
        F.lit(None).cast("string").alias("c_comment_h"),
    )
    return clean.clean_dataframe(df)


@query(
    "drop_incomplete",
    f"""WITH {CUSTOMER_SQL}
    SELECT count(*) AS rows_before, count(*) FILTER (c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL) AS rows_after,
           count(*) FILTER (c_acctbal IS NULL OR c_mktsegment IS NULL) AS rows_excluded FROM customer_h""",
)
def q_drop_incomplete(spark, sf_dir):
    return clean.excluded_counts(customer_with_holes(spark, sf_dir), ["c_acctbal", "c_mktsegment"])


@query(
    "row_constraints",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         array_to_string(list_filter([CASE WHEN NOT l_quantity > 1 THEN 'quantity' END,
                      CASE WHEN NOT l_extendedprice >= 1000 THEN 'price' END,
                      CASE WHEN NOT l_discount <= 0.09 THEN 'discount' END], lambda x: x IS NOT NULL), ',') AS reasons,
         (l_quantity > 1 AND l_extendedprice >= 1000 AND l_discount <= 0.09) AS valid
       FROM lineitem""",
)
def q_row_constraints(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    rules = {
        "quantity": F.col("l_quantity") > 1,
        "price": F.col("l_extendedprice") >= 1000,
        "discount": F.col("l_discount") <= 0.09,
    }
    return clean.check_rows(df, rules).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "even_sample",
    """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
       n AS (SELECT count(*) AS n FROM orders),
       pick AS (SELECT DISTINCT (j * (n - 1)) // 99 AS i FROM n, range(0, 100) AS t(j))
       SELECT o_orderkey, o_totalprice FROM r JOIN pick USING (i)""",
)
def q_even_sample(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return clean.even_sample(df, ["o_orderkey"], 100)


@query(
    "median_binarize",
    """WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS mq, quantile_cont(l_extendedprice, 0.5) AS mp FROM lineitem)
       SELECT l_returnflag, CAST(l_quantity > mq AS INTEGER) AS l_quantity,
              CAST(l_extendedprice > mp AS INTEGER) AS l_extendedprice, count(*) AS n
       FROM lineitem, m GROUP BY ALL""",
)
def q_median_binarize(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    out = clean.median_binarize(df, ["l_quantity", "l_extendedprice"])
    return out.groupBy("l_returnflag", "l_quantity", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))


@query(
    "profile_columns",
    CUSTOMER_STATS
    + """SELECT position, "column", dtype, missing, round(missing / greatest(n_rows, 1), 6) AS missing_pct, uniq AS "unique", example
         FROM stats""",
)
def q_profile_columns(spark, sf_dir):
    out = profile.profile_columns(customer_with_holes(spark, sf_dir))
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "profile_table",
    """WITH t AS (SELECT CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS q, l_returnflag, l_linestatus, l_discount
                 FROM lineitem),
       g AS (SELECT q, l_returnflag, l_linestatus, l_discount, count(*) AS c FROM t GROUP BY ALL)
       SELECT CAST(sum(c) AS BIGINT) AS n_rows, 4 AS n_columns, CAST(sum(CASE WHEN q IS NULL THEN c ELSE 0 END) AS BIGINT) AS missing_cells,
              CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM g""",
)
def q_profile_table(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("q"), "l_returnflag", "l_linestatus", "l_discount"
    )
    return profile.profile_table(df)


@query(
    "duplicate_rows",
    """SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM
       (SELECT count(*) AS c FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority)""",
)
def q_duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    "guess_task_type",
    CUSTOMER_STATS
    + """SELECT "column", uniq AS "unique", present, CASE WHEN uniq <= 1 THEN 'invalid'
              WHEN is_number AND NOT (uniq <= 20 AND uniq / greatest(present, 1) <= 0.15) THEN 'regression'
              ELSE 'classification' END AS task_type FROM stats""",
)
def q_guess_task_type(spark, sf_dir):
    return profile.guess_task_types(customer_with_holes(spark, sf_dir))


@query(
    "suggest_targets",
    ORDERS_STATS
    + """, t AS (SELECT *, CASE WHEN uniq <= 1 THEN 'invalid'
              WHEN is_number AND NOT (uniq <= 20 AND uniq / greatest(present, 1) <= 0.15) THEN 'regression'
              ELSE 'classification' END AS task_type FROM stats)
       SELECT position, "column", task_type, uniq AS "unique", round(missing / n_rows, 6) AS missing_pct,
         (CASE WHEN uniq BETWEEN 2 AND 20 THEN 2.0::DOUBLE ELSE 0 END) + (CASE WHEN missing = 0 THEN 1.0::DOUBLE ELSE 0 END)
         + (CASE WHEN lower("column") IN ('target','label','class','type','category','outcome') THEN 2 ELSE 0 END)
         + (CASE WHEN regexp_matches(lower("column"), 'class|target|label') THEN 1 ELSE 0 END)
         + (CASE WHEN regexp_matches(lower("column"), 'risk|level|status|outcome') THEN 2 ELSE 0 END)
         + (CASE WHEN position = 3 THEN 1 ELSE 0 END)
         + (CASE WHEN task_type = 'regression' AND is_number THEN 0.5::DOUBLE ELSE 0 END) AS score
       FROM t WHERE task_type <> 'invalid'""",
)
def q_suggest_targets(spark, sf_dir):
    out = profile.suggest_targets(table(spark, sf_dir, "orders").select(*ORDERS_COLUMNS))
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "suggest_features",
    CUSTOMER_STATS
    + """SELECT position, "column", dtype, uniq AS "unique", round(missing / n_rows, 6) AS missing_pct,
              NOT (uniq <= 1 OR missing / n_rows >= 0.8) AS usable,
              CASE WHEN uniq <= 1 THEN 'constant' WHEN missing / n_rows >= 0.8 THEN 'too many missing values' ELSE 'usable' END AS reason
         FROM stats WHERE "column" <> 'c_mktsegment'""",
)
def q_suggest_features(spark, sf_dir):
    out = profile.suggest_features(customer_with_holes(spark, sf_dir), "c_mktsegment")
    return out.withColumn("missing_pct", F.round("missing_pct", 6))


VALIDATE_SQL = """, v AS (SELECT position, "column", is_number, uniq AS n_classes, min_count AS min_class_count,
    (is_number AND uniq >= 20 AND uniq / greatest(present, 1) > 0.10) AS appears_continuous, present
  FROM stats), r AS (
  SELECT *, CASE WHEN present = 0 THEN 'no values' WHEN n_classes < 2 THEN 'fewer than two classes'
    WHEN appears_continuous THEN 'continuous'
    WHEN n_classes > least(10, greatest(2, present // 7)) THEN 'too many classes'
    WHEN min_class_count < 2 THEN 'class with a single row'
    WHEN min_class_count < 7 THEN 'smallest class too small for the folds' END AS reason FROM v)
"""


@query(
    "validate_target",
    CUSTOMER_STATS
    + VALIDATE_SQL
    + """SELECT position, "column", is_number, reason IS NULL AS valid, reason, appears_continuous, n_classes, min_class_count FROM r""",
)
def q_validate_target(spark, sf_dir):
    return profile.validate_targets(customer_with_holes(spark, sf_dir))


@query(
    "recommend_targets",
    ORDERS_STATS
    + VALIDATE_SQL
    + """SELECT "column", regexp_matches(lower("column"), 'target|label|class|type|category|outcome') AS named, is_number,
             n_classes, position FROM r WHERE reason IS NULL""",
)
def q_recommend_targets(spark, sf_dir):
    return profile.recommend_targets(table(spark, sf_dir, "orders").select(*ORDERS_COLUMNS))


def schema_issue_sql(target: str, n_columns: int, source: str, columns: dict[str, tuple[str, bool]]) -> str:
    group = ", ".join(columns)
    return f""", dup AS (SELECT coalesce(sum(c), 0) AS n_rows, coalesce(sum(c - 1), 0) AS d
             FROM (SELECT count(*) AS c FROM {source} GROUP BY {group})),
    s AS (SELECT *, missing / greatest(n_rows, 1) AS rate, "column" = '{target}' AS is_target FROM stats),
    raw_issues AS (
      SELECT "column", CASE WHEN rate > 0.5 THEN 'error' WHEN rate >= 0.1 THEN 'warning' ELSE 'info' END AS severity,
             CASE WHEN rate > 0.5 THEN 'mostly_missing' WHEN rate >= 0.1 THEN 'many_missing' ELSE 'some_missing' END AS rule,
             rate AS measured FROM s WHERE rate >= 0.01
      UNION ALL SELECT "column", CASE WHEN is_target AND uniq <= 1 THEN 'error' WHEN uniq = 1 THEN 'warning' ELSE 'info' END,
             CASE WHEN is_target AND uniq <= 1 THEN 'single_class' WHEN uniq = 1 THEN 'constant' ELSE 'low_cardinality' END, uniq
        FROM s WHERE (is_target AND uniq <= 1) OR uniq = 1 OR (uniq < 3 AND n_rows > 20)
      UNION ALL SELECT "column", 'warning', 'identifier_like', uniq FROM s WHERE is_text AND uniq > 0.5 * n_rows
      UNION ALL SELECT "column", 'warning', 'extreme_value', CASE WHEN lo < mu - 10 * sd THEN lo ELSE hi END FROM s
        WHERE is_number AND present >= 2 AND sd > 0 AND (lo < mu - 10 * sd OR hi > mu + 10 * sd)
      UNION ALL SELECT "column", 'info', 'numeric_target', uniq FROM s WHERE is_target AND is_number AND uniq > 20
      UNION ALL SELECT NULL, 'warning', 'few_rows', n_rows FROM dup WHERE n_rows > 0 AND n_rows < 30
      UNION ALL SELECT NULL, 'error', 'few_columns', {n_columns} WHERE {n_columns} < 2
      UNION ALL SELECT NULL, 'warning', 'duplicate_rows', d FROM dup WHERE d > 0)"""


HOLED_ORDERS_SQL = """
o AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus,
             CASE WHEN o_orderkey = 0 THEN 1e12::DOUBLE ELSE o_totalprice END AS o_totalprice,
             CAST(o_orderkey AS VARCHAR) AS o_code, 'EUR' AS o_currency, o_orderpriority FROM orders)"""
HOLED_ORDERS_COLUMNS = {
    "o_custkey": ("bigint", True),
    "o_orderstatus": ("string", False),
    "o_totalprice": ("double", True),
    "o_code": ("string", False),
    "o_currency": ("string", False),
    "o_orderpriority": ("string", False),
}


def holed_orders(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        "o_orderstatus",
        F.when(key == 0, F.lit(1e12)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        key.cast("string").alias("o_code"),
        F.lit("EUR").alias("o_currency"),
        "o_orderpriority",
    )


SCHEMA_ISSUES = (
    f"WITH {HOLED_ORDERS_SQL}, {stats_sql('o', HOLED_ORDERS_COLUMNS)}"
    + schema_issue_sql("o_orderpriority", len(HOLED_ORDERS_COLUMNS), "o", HOLED_ORDERS_COLUMNS)
)


@query(
    "schema_issues",
    SCHEMA_ISSUES
    + """SELECT severity, 'schema' AS category, "column", rule, round(measured, 6) AS measured FROM raw_issues""",
)
def q_schema_issues(spark, sf_dir):
    out = schema_rules.schema_issues(holed_orders(spark, sf_dir), "o_orderpriority")
    return out.select("severity", "category", "column", "rule", F.round("measured", 6).alias("measured"))


@query(
    "issue_summary",
    SCHEMA_ISSUES
    + """, c AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
              count(*) FILTER (severity = 'info') AS infos FROM raw_issues)
       SELECT *, errors = 0 AS passed, CASE WHEN errors + warnings + infos = 0 THEN 'no findings' ELSE
         concat(errors, ' error, ', warnings, ' warning, ', infos, ' info') END AS summary FROM c""",
)
def q_issue_summary(spark, sf_dir):
    return schema_rules.issue_summary(schema_rules.schema_issues(holed_orders(spark, sf_dir), "o_orderpriority"))


@query(
    "issue_rollup",
    SCHEMA_ISSUES
    + """SELECT severity, category, count(*) AS findings, grouping(severity, category)::INTEGER AS level
         FROM (SELECT *, 'schema' AS category FROM raw_issues) GROUP BY ROLLUP (severity, category)""",
)
def q_issue_rollup(spark, sf_dir):
    return schema_rules.issue_rollup(schema_rules.schema_issues(holed_orders(spark, sf_dir), "o_orderpriority"))
