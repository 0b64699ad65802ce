"""Drift, leakage, association and feature-ranking queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from plumbrule.operators import association, drift
from plumbrule.plans.profiling import schema_issue_sql, stats_sql
from plumbrule.plans.registry import query, table

CUT = datetime.datetime(1998, 1, 1)


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def orders_sides(spark, sf_dir, *columns):
    orders = table(spark, sf_dir, "orders")
    return (
        orders.where(F.col("o_orderdate") < F.lit(CUT)).select(*columns),
        orders.where(F.col("o_orderdate") >= F.lit(CUT)).select(*columns),
    )


SIDES = """
refs AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
news AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"""


def ks_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", max(abs(cr / nr - cn / nn)) AS statistic, max(nr) AS n_ref, max(nn) AS n_new
      FROM (SELECT sum(r) OVER (ORDER BY v) AS cr, sum(n) OVER (ORDER BY v) AS cn, sum(r) OVER () AS nr, sum(n) OVER () AS nn
            FROM (SELECT v, sum(r)::DOUBLE AS r, sum(n)::DOUBLE AS n FROM
                  (SELECT {column}::DOUBLE AS v, 1 AS r, 0 AS n FROM refs UNION ALL SELECT {column}::DOUBLE, 0, 1 FROM news)
                  WHERE v IS NOT NULL GROUP BY v))"""


def side_moments(column: str) -> str:
    return f"""SELECT '{column}' AS "column", (SELECT avg({column}) FROM refs) AS reference_mean,
      (SELECT avg({column}) FROM news) AS new_mean, (SELECT stddev_pop({column}) FROM refs) AS reference_std,
      (SELECT stddev_pop({column}) FROM news) AS new_std"""


KS = f"""ks AS ({ks_sql('o_totalprice')} UNION ALL {ks_sql('o_custkey')}),
 mom AS ({side_moments('o_totalprice')} UNION ALL {side_moments('o_custkey')}),
 ksp AS (SELECT *, statistic * statistic * n_ref * n_new / (n_ref + n_new) AS lam2 FROM ks),
 ksr AS (SELECT "column", statistic, CASE WHEN lam2 < 0.02 THEN 1.0 ELSE least(greatest(
    list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * lam2))), 0.0), 1.0) END AS p_value
    FROM ksp)"""


@query(
    "ks_drift",
    f"""WITH {SIDES}, {KS} SELECT "column", round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value < 0.05 AS drifted,
    round(reference_mean, 4) AS reference_mean, round(new_mean, 4) AS new_mean, round(reference_std, 4) AS reference_std,
    round(new_std, 4) AS new_std FROM ksr JOIN mom USING ("column")""",
)
def q_ks(spark, sf_dir):
    ref, new = orders_sides(spark, sf_dir, "o_totalprice", "o_custkey")
    out = drift.numeric_drift(ref, new, ["o_totalprice", "o_custkey"])
    out = rounded(rounded(out, "statistic", "p_value"), "reference_mean", "new_mean", "reference_std", "new_std", digits=4)
    return out.select("column", "statistic", "p_value", "drifted", "reference_mean", "new_mean", "reference_std", "new_std")


# 0.95 quantiles of the chi-squared distribution, used by the SQL side only
CRITICAL = "[3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.06714, 15.507313]"


def chi_sql(column: str, mangle: str = "{c}") -> str:
    c = mangle.format(c=column)
    return f"""SELECT '{column}' AS "column", v, count(*) FILTER (s = 0) AS r, count(*) FILTER (s = 1) AS n
      FROM (SELECT coalesce({c}, '<MISSING>') AS v, 0 AS s FROM refs UNION ALL SELECT coalesce({c}, '<MISSING>'), 1 FROM news) GROUP BY v"""


CHI_TAIL = """tot AS (SELECT "column", sum(r)::DOUBLE AS nr, sum(n)::DOUBLE AS nn, count(*) AS k FROM cat GROUP BY 1),
 e AS (SELECT *, nr * (r + n) / (nr + nn) AS er, nn * (r + n) / (nr + nn) AS en FROM cat JOIN tot USING ("column")),
 d AS (SELECT *, abs(er - r) - CASE WHEN k = 2 THEN least(0.5, abs(er - r)) ELSE 0 END AS dr,
                 abs(en - n) - CASE WHEN k = 2 THEN least(0.5, abs(en - n)) ELSE 0 END AS dn FROM e),
 chi AS (SELECT "column", sum(dr * dr / er + dn * dn / en) AS statistic, max(k) - 1 AS dof,
   0.5 * sum(abs(r / nr - n / nn)) AS total_variation_distance, min(least(er, en)) < 5 AS low_expected_counts FROM d GROUP BY 1)"""

HOLED_PRIORITY = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {c} END"
CHI = f"cat AS ({chi_sql('o_orderstatus')} UNION ALL {chi_sql('o_orderpriority', HOLED_PRIORITY)}), {CHI_TAIL}"


def category_sides(spark, sf_dir):
    ref, new = orders_sides(spark, sf_dir, "o_orderkey", "o_orderstatus", "o_orderpriority")
    hole = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority")
    return ref.select("o_orderstatus", hole), new.select("o_orderstatus", hole)


@query(
    "chi2_drift",
    f"""WITH {SIDES}, {CHI} SELECT "column", round(statistic, 6) AS statistic, dof, statistic > ({CRITICAL})[dof] AS drifted,
      round(total_variation_distance, 6) AS total_variation_distance, low_expected_counts FROM chi""",
)
def q_chi2(spark, sf_dir):
    out = drift.categorical_drift(*category_sides(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])
    out = rounded(out, "statistic", "total_variation_distance")
    return out.select("column", "statistic", "dof", "drifted", "total_variation_distance", "low_expected_counts")


REPORT = f"""WITH {SIDES}, {KS}, cat AS ({chi_sql('o_orderstatus')}), {CHI_TAIL}, report AS (
   SELECT "column", 'kolmogorov-smirnov' AS test, statistic, NULL::BIGINT AS dof, p_value < 0.05 AS drifted, NULL::DOUBLE AS total_variation_distance,
          NULL::BOOLEAN AS low_expected_counts FROM ksr
   UNION ALL SELECT "column", 'chi-squared', statistic, dof, statistic > ({CRITICAL})[dof], total_variation_distance, low_expected_counts FROM chi)"""


@query(
    "drift_report",
    REPORT
    + """ SELECT "column", test, round(statistic, 6) AS statistic, dof, drifted, round(total_variation_distance, 6) AS total_variation_distance,
          low_expected_counts FROM report""",
)
def q_drift_report(spark, sf_dir):
    ref, new = orders_sides(spark, sf_dir, "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")
    out = drift.drift_report(ref, new, "o_orderpriority")
    out = rounded(out, "statistic", "total_variation_distance")
    return out.select("column", "test", "statistic", "dof", "drifted", "total_variation_distance", "low_expected_counts")


@query(
    "schema_diff",
    """WITH r AS (SELECT unnest(map_keys(any_value(j))) AS c FROM (SELECT MAP {'o_orderkey': count(o_orderkey), 'o_totalprice': count(o_totalprice),
          'o_orderstatus': count(o_orderstatus)} AS j FROM orders)),
       n AS (SELECT unnest(map_keys(any_value(j))) AS c FROM (SELECT MAP {'o_orderkey': count(o_orderkey), 'o_orderstatus': count(o_orderstatus),
          'o_orderdate': count(o_orderdate)} AS j FROM orders))
       SELECT c AS "column", 'error' AS severity, 'column_lost' AS rule FROM r WHERE c NOT IN (SELECT c FROM n)
       UNION ALL SELECT c, 'warning', 'column_new' FROM n WHERE c NOT IN (SELECT c FROM r)""",
)
def q_schema_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ref = orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    return drift.schema_difference_rows(ref, new).select("column", "severity", "rule")


PART_ID = """
p AS (SELECT p_type, p_size, p_retailprice, p_brand, 'x' || p_type AS type_copy,
        CASE p_type WHEN 'ECONOMY' THEN 'z' ELSE 'y' || p_type END AS type_relabelled FROM part)"""


def part_with_copies(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_type",
        "p_size",
        "p_retailprice",
        "p_brand",
        F.concat(F.lit("x"), "p_type").alias("type_copy"),
        F.when(F.col("p_type") == "ECONOMY", "z").otherwise(F.concat(F.lit("y"), "p_type")).alias("type_relabelled"),
    )


def identity_sql(features, target, source):
    one = """SELECT '{f}' AS "column", CASE WHEN (SELECT bool_and(rf = rt) AND count(*) = count(DISTINCT rf) AND count(*) = count(DISTINCT rt)
       FROM (SELECT dense_rank() OVER (ORDER BY {f}) AS rf, dense_rank() OVER (ORDER BY {t}) AS rt
             FROM (SELECT DISTINCT {f}, {t} FROM {s} WHERE {f} IS NOT NULL AND {t} IS NOT NULL))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS identity_score"""
    return " UNION ALL ".join(one.format(f=f, t=target, s=source) for f in features)


PART_FEATURES = ["p_size", "p_retailprice", "p_brand", "type_copy", "type_relabelled"]


@query("identity_score", f"WITH {PART_ID} {identity_sql(PART_FEATURES, 'p_type', 'p')}")
def q_identity(spark, sf_dir):
    return association.identity_scores(part_with_copies(spark, sf_dir), "p_type", PART_FEATURES)


def eta_sql(feature, target, source):
    return f"""SELECT '{feature}' AS "column", sum(n * (m - mu) * (m - mu)) / (sum(n * (m - mu) * (m - mu)) + sum(w)) AS eta2
     FROM (SELECT count(*) AS n, avg({target}) AS m, var_pop({target}) * count(*) AS w FROM {source} WHERE {feature} IS NOT NULL GROUP BY {feature}),
          (SELECT avg({target}) AS mu FROM {source} WHERE {feature} IS NOT NULL)"""


@query(
    "correlation_ratio",
    f"""SELECT "column", round(eta2, 6) AS eta2 FROM ({eta_sql('l_returnflag', 'l_extendedprice', 'lineitem')}
        UNION ALL {eta_sql('l_linestatus', 'l_extendedprice', 'lineitem')} UNION ALL {eta_sql('l_linenumber', 'l_extendedprice', 'lineitem')})""",
)
def q_correlation_ratio(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = association.correlation_ratios(df, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice")
    return rounded(out, "eta2")


def cells_sql(features, target, source):
    """features: name -> SQL of its category"""
    return " UNION ALL ".join(
        f"SELECT '{f}' AS \"column\", CAST({e} AS VARCHAR) AS x, CAST({target} AS VARCHAR) AS y FROM {source}" for f, e in features.items()
    )


MI_TAIL = """cnt AS (SELECT "column", x, y, count(*)::DOUBLE AS n FROM cells GROUP BY ALL),
 mi AS (SELECT "column", greatest((sum(n * ln(n)) - (SELECT sum(s * ln(s)) FROM (SELECT sum(n) AS s FROM cnt c2 WHERE c2."column" = cnt."column" GROUP BY x))
    - (SELECT sum(s * ln(s)) FROM (SELECT sum(n) AS s FROM cnt c2 WHERE c2."column" = cnt."column" GROUP BY y))) / sum(n) + ln(sum(n)), 0.0) AS mi,
    count(DISTINCT y) AS k, count(DISTINCT x) AS kx, sum(n) AS n FROM cnt GROUP BY "column")"""


def binned(column, source, bins=10, cond=""):
    """SQL for the number of distinct decile edges at or below the (median-filled) value"""
    probs = ", ".join(str(i / bins) for i in range(1, bins))
    return (
        f"(SELECT count(*) FROM (SELECT DISTINCT unnest(q) AS e FROM (SELECT quantile_cont(coalesce({column}, (SELECT quantile_cont({column}, 0.5) FROM {source})), [{probs}]) AS q"
        f" FROM {source})) WHERE e <= {column}_v)"
    )


def binned_source(columns, source, name):
    """CTEs: edges per column and ``name`` with <c>_b codes"""
    edges = ", ".join(
        f"list_distinct(quantile_cont(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {source})), [{', '.join(str(i / 10) for i in range(1, 10))}])) AS {c}_e,"
        f" quantile_cont({c}, 0.5) AS {c}_m"
        for c in columns
    )
    codes = ", ".join(
        f"len(list_filter({c}_e, lambda e: e <= coalesce({c}, {c}_m)))::INTEGER AS {c}_b" for c in columns
    )
    return f"{name}_e AS (SELECT {edges} FROM {source}), {name} AS (SELECT s.*, {codes} FROM {source} s, {name}_e)"


HOLED_LINES = """li AS (SELECT l_returnflag, l_linestatus, l_linenumber,
   CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, l_discount,
   CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS flag_h FROM lineitem)"""


def holed_lines(spark, sf_dir):
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        "l_linenumber",
        F.when(key % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        F.when(key % 5 != 0, F.col("l_returnflag")).alias("flag_h"),
    )


@query(
    "discrete_mi",
    f"""WITH {HOLED_LINES}, cells AS ({cells_sql({'l_linestatus': 'l_linestatus', 'flag_h': "coalesce(flag_h, '<MISSING>')"}, 'l_returnflag', 'li')}), {MI_TAIL}
    SELECT "column", round(mi, 6) AS mi, round(least(mi / ln(k), 1.0), 6) AS normalized FROM mi""",
)
def q_discrete_mi(spark, sf_dir):
    counts = association.pair_counts(holed_lines(spark, sf_dir), ["l_linestatus", "flag_h"], "l_returnflag")
    out = association.association_facts(counts).select(
        "column", "mi", F.least(F.col("mi") / F.ln("n_classes"), F.lit(1.0)).alias("normalized")
    )
    return rounded(out, "mi", "normalized")


NUMERIC_LINES = ["l_quantity", "l_extendedprice", "l_discount"]


def filled_cells(columns, target, source):
    """One row per row and column: ``f, label, v``, missing values filled by the median."""
    cells = ", ".join(f"{{'f': '{c}', 'v': coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM {source}))::DOUBLE}}" for c in columns)
    return f"SELECT {target} AS label, unnest([{cells}], recursive := true) FROM {source}"


def nearest_sql(cells, name="near", k=3):
    """CTEs ending in ``name`` ("column", mi): nearest-neighbour information of v with label for every f of ``cells``."""
    sides = ", ".join(f"{{'d': abs({fn}(v, {j}) OVER w - v), 'n': {fn}(n, {j}) OVER w}}" for j in range(1, k + 1) for fn in ("lag", "lead"))
    p = name
    return f"""{p}_f AS (SELECT f, label, v, count(*) AS n FROM ({cells}) GROUP BY ALL),
 {p}_z AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY f, label) AS size FROM {p}_f) WHERE size > 1),
 {p}_w AS (SELECT *, least({k}, size - 1) AS kk, list_sort(list_filter([{sides}], lambda s: s.d IS NOT NULL)) AS sides FROM {p}_z WINDOW w AS (PARTITION BY f, label ORDER BY v)),
 {p}_r AS (SELECT f, v, n, size, kk, CASE WHEN n - 1 >= kk THEN 0 ELSE list_min(list_transform(list_filter(range(1, len(sides) + 1),
      lambda i: n - 1 + list_sum(list_transform(sides[1:i], lambda s: s.n)) >= kk), lambda i: sides[i].d)) END AS r FROM {p}_w),
 {p}_c AS (SELECT f, v, sum(sum(n)) OVER (PARTITION BY f ORDER BY v) AS c FROM {p}_z GROUP BY f, v),
 {p}_a AS (SELECT *, v + r * (1 - 1e-9) AS hi, v - r * (1 - 1e-9) AS lo FROM {p}_r),
 {p}_h AS (SELECT a.*, h.c AS upto FROM {p}_a a ASOF JOIN {p}_c h ON a.f = h.f AND a.hi >= h.v),
 {p}_m AS (SELECT a.*, upto - coalesce(l.c, 0) AS m FROM {p}_h a ASOF LEFT JOIN {p}_c l ON a.f = l.f AND a.lo > l.v),
 {p}_p AS (SELECT i, -0.5772156649015329 + sum(CASE WHEN i > 1 THEN 1.0::DOUBLE / (i - 1) ELSE 0 END) OVER (ORDER BY i) AS psi FROM range(1, (SELECT max(t) FROM (SELECT sum(n)::BIGINT AS t FROM {p}_f GROUP BY f)) + 1) AS r(i)),
 {p}_t AS (SELECT f, sum(n) AS rows, sum(n * (pk.psi - ps.psi - pm.psi)) / sum(n) AS e FROM {p}_m
    JOIN {p}_p pk ON pk.i = CASE WHEN r > 0 THEN kk ELSE n END JOIN {p}_p ps ON ps.i = size JOIN {p}_p pm ON pm.i = m GROUP BY f),
 {name} AS (SELECT f AS "column", greatest(psi + e, 0) AS mi FROM {p}_t JOIN {p}_p ON i = rows)"""


@query(
    "binned_mi",
    f"""WITH {HOLED_LINES}, {binned_source(NUMERIC_LINES, 'li', 'lb')},
    cells AS ({cells_sql({c: c + '_b' for c in NUMERIC_LINES}, 'l_returnflag', 'lb')}), {MI_TAIL}
    SELECT "column" AS feature, round(mi, 6) AS mutual_information FROM mi""",
)
def q_binned_mi(spark, sf_dir):
    df = holed_lines(spark, sf_dir)
    return rounded(association.feature_information(df, "l_returnflag", NUMERIC_LINES, bins=10), "mutual_information")


LEAK_CELLS = {
    "l_linestatus": "l_linestatus",
    "flag_h": "coalesce(flag_h, '<MISSING>')",
    "row_code": "row_code",
    "flag_copy": "flag_copy",
    "half_flag": "half_flag",
}
LEAK_SOURCE = f"""{HOLED_LINES.replace("AS flag_h FROM lineitem)", '''AS flag_h,
   l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS row_code, 'c' || l_returnflag AS flag_copy,
   CASE WHEN l_orderkey % 2 = 0 THEN l_returnflag END AS half_flag FROM lineitem)''')}"""
LEAK_NUMBERS = [*NUMERIC_LINES, "l_linenumber"]
LEAK = f"""WITH {LEAK_SOURCE}, cells AS ({cells_sql(LEAK_CELLS, 'l_returnflag', 'li')}), {MI_TAIL}, {nearest_sql(filled_cells(LEAK_NUMBERS, 'l_returnflag', 'li'))},
 same AS ({identity_sql([*LEAK_CELLS, *LEAK_NUMBERS], 'l_returnflag', 'li')}),
 every AS (SELECT "column", mi, kx / n AS share FROM mi UNION ALL SELECT "column", mi, NULL FROM near),
 scores AS (SELECT "column", CASE WHEN identity_score = 1.0 THEN 1.0::DOUBLE WHEN share > 0.5 THEN 0.0::DOUBLE
   ELSE least(mi / ln((SELECT max(k) FROM mi)), 1.0) END AS score FROM every JOIN same USING ("column"))"""


def leaky_lines(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    return df.select(
        "l_returnflag",
        "l_linestatus",
        "l_linenumber",
        F.when(key % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        F.when(key % 5 != 0, F.col("l_returnflag")).alias("flag_h"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_code"),
        F.concat(F.lit("c"), "l_returnflag").alias("flag_copy"),
        F.when(key % 2 == 0, F.col("l_returnflag")).alias("half_flag"),
    )


@query("leakage_scores", LEAK + """ SELECT "column", round(score, 6) AS score FROM scores""")
def q_leakage(spark, sf_dir):
    return rounded(association.leakage_scores(leaky_lines(spark, sf_dir), "l_returnflag", "classification"), "score")


@query(
    "leakage_issues",
    LEAK
    + """ SELECT "column", CASE WHEN score > 0.95 THEN 'error' WHEN score >= 0.8 THEN 'warning' ELSE 'info' END AS severity,
       CASE WHEN score > 0.95 THEN 'leak_extreme' WHEN score >= 0.8 THEN 'leak_very_strong' ELSE 'leak_strong' END AS rule,
       round(score, 6) AS measured FROM scores WHERE score >= 0.6""",
)
def q_leakage_issues(spark, sf_dir):
    out = association.leakage_issues(leaky_lines(spark, sf_dir), "l_returnflag", "classification")
    return rounded(out, "measured").select("column", "severity", "rule", "measured")


@query(
    "leakage_scores_reg",
    f"""WITH li AS (SELECT l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_extendedprice * 2 + 1 AS price_copy FROM lineitem),
    s AS (SELECT 'l_quantity' AS "column", abs(corr(l_quantity, l_extendedprice)) AS score FROM li
      UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM li
      UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM li
      UNION ALL SELECT 'price_copy', 1.0::DOUBLE
      UNION ALL {eta_sql('l_returnflag', 'l_extendedprice', 'li')} UNION ALL {eta_sql('l_linestatus', 'l_extendedprice', 'li')})
    SELECT "column", round(score, 6) AS score FROM s""",
)
def q_leakage_reg(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        (F.col("l_extendedprice") * 2 + 1).alias("price_copy"),
    )
    return rounded(association.leakage_scores(df, "l_extendedprice", "regression"), "score")


RANK_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
RANK_TEXTS = {"l_linestatus": "l_linestatus", "flag_h": "coalesce(flag_h, '<MISSING>')"}
RANK_CELLS = [*RANK_NUMBERS, *RANK_TEXTS]
RANK = f"""WITH {HOLED_LINES}, cells AS ({cells_sql(RANK_TEXTS, 'l_returnflag', 'li')}), {MI_TAIL.replace('mi AS (SELECT', 'mi_text AS (SELECT', 1)},
  {nearest_sql(filled_cells(RANK_NUMBERS, 'l_returnflag', 'li'))}, mi AS (SELECT "column", mi FROM mi_text UNION ALL SELECT "column", mi FROM near)"""
RANK_STATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, '{t}' AS dtype, count(DISTINCT {c}) AS "unique", (count(*) - count({c})) / count(*) AS missing_pct FROM li"""
    for c, t in {"l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_linenumber": "int", "l_linestatus": "string", "flag_h": "string"}.items()
)
RANK_FULL = RANK + f""", st AS ({RANK_STATS}), j AS (SELECT st.*, mi AS mutual_information, mi / (SELECT greatest(max(mi), 1e-12) FROM mi) AS share,
    mi / (SELECT greatest(sum(mi), 1e-12) FROM mi) AS mi_share FROM st JOIN mi ON st.feature = mi."column")"""


@query("rank_features", RANK + """ SELECT "column" AS feature, round(mi, 6) AS mutual_information FROM mi ORDER BY mi DESC, "column" LIMIT 12""")
def q_rank(spark, sf_dir):
    out = association.rank_features(holed_lines(spark, sf_dir), "l_returnflag", list(RANK_CELLS))
    return rounded(out, "mutual_information")


PART_NUMBERS = ["p_size", "p_partkey", "size_class", "flat"]
PART_TEXTS = ["p_type", "p_brand"]
PART_HOLED = """pa AS (SELECT p_retailprice, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size, p_partkey, p_size // 10 AS size_class, 1 AS flat,
   p_type, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS p_brand FROM part)"""


@query(
    "rank_features_regression",
    f"""WITH {PART_HOLED},
    {nearest_sql(" UNION ALL ".join(f"SELECT '{c}' AS f, coalesce({c}, '<MISSING>') AS label, p_retailprice::DOUBLE AS v FROM pa" for c in PART_TEXTS))},
    pc AS (SELECT f, p_partkey AS id, label / (SELECT stddev_pop(p_retailprice) FROM pa) AS y, v FROM (SELECT p_partkey, {filled_cells(PART_NUMBERS, 'p_retailprice', 'pa').removeprefix('SELECT ')})),
    ps AS (SELECT f, id, y, v / coalesce(nullif(stddev_pop(v) OVER (PARTITION BY f), 0), 1) AS x FROM pc),
    pd AS (SELECT a.f, a.id, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.f, a.id ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) AS rn FROM ps a JOIN ps b ON a.f = b.f AND a.id <> b.id),
    pr AS (SELECT ps.*, d AS r FROM pd JOIN ps USING (f, id) WHERE rn = 3),
    pn AS (SELECT a.f, a.id, CASE WHEN any_value(r) > 0 THEN 3 ELSE count(*) FILTER (a.x = b.x AND a.y = b.y) END AS k,
        count(*) FILTER (abs(a.x - b.x) < r * (1 - 1e-9) OR (r = 0 AND a.x = b.x)) AS nx, count(*) FILTER (abs(a.y - b.y) < r * (1 - 1e-9) OR (r = 0 AND a.y = b.y)) AS ny
      FROM pr a JOIN ps b USING (f) GROUP BY a.f, a.id),
    pe AS (SELECT f, count(*) AS rows, avg(k.psi - x.psi - y.psi) AS e FROM pn JOIN near_p k ON k.i = pn.k JOIN near_p x ON x.i = nx JOIN near_p y ON y.i = ny GROUP BY f),
    mi AS (SELECT "column", mi FROM near UNION ALL SELECT f, greatest(psi + e, 0) FROM pe JOIN near_p ON i = rows)
    SELECT "column" AS feature, round(mi, 6) AS mutual_information FROM mi""",
)
def q_rank_regression(spark, sf_dir):
    key = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select(
        "p_retailprice", F.when(key % 7 != 0, F.col("p_size")).alias("p_size"), "p_partkey", F.floor(F.col("p_size") / 10).alias("size_class"), F.lit(1).alias("flat"),
        "p_type", F.when(key % 5 != 0, F.col("p_brand")).alias("p_brand"),
    )
    out = association.rank_features(df, "p_retailprice", [*PART_NUMBERS, *PART_TEXTS], None, "regression")
    return rounded(out, "mutual_information")


@query(
    "recommend_features",
    RANK_FULL
    + """ SELECT feature, dtype, "unique", round(missing_pct, 6) AS missing_pct, round(mutual_information, 6) AS mutual_information,
      round(0.8 * share + 0.2 * (1 - missing_pct), 6) AS quality_score,
      CASE WHEN "unique" <= 1 THEN 'Remove' WHEN missing_pct >= 0.5 THEN 'Weak' WHEN share >= 0.65 THEN 'Strong' WHEN share >= 0.25 THEN 'Moderate' ELSE 'Weak' END AS recommendation
      FROM j""",
)
def q_recommend(spark, sf_dir):
    out = association.recommend_features(holed_lines(spark, sf_dir), "l_returnflag", list(RANK_CELLS))
    return rounded(out, "missing_pct", "mutual_information", "quality_score").drop("reason")


@query(
    "feature_diagnostics",
    RANK_FULL
    + """ SELECT feature, dtype, "unique", round(missing_pct, 6) AS missing_pct, round(mutual_information, 6) AS mutual_information, round(mi_share, 6) AS mi_share FROM j""",
)
def q_feature_diagnostics(spark, sf_dir):
    out = association.feature_diagnostics(holed_lines(spark, sf_dir), "l_returnflag", list(RANK_CELLS))
    return rounded(out, "missing_pct", "mutual_information", "mi_share")


@query(
    "target_associations",
    RANK
    + """, codes AS (SELECT l_returnflag AS lf, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM li)),
    f AS (SELECT code::DOUBLE AS y, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM li)) AS l_quantity, l_extendedprice, l_discount, l_linenumber FROM li JOIN codes ON lf = l_returnflag),
    r AS (SELECT 'l_quantity' AS feature, corr(l_quantity, y) AS r FROM f UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, y) FROM f
      UNION ALL SELECT 'l_discount', corr(l_discount, y) FROM f UNION ALL SELECT 'l_linenumber', corr(l_linenumber, y) FROM f)
    SELECT feature, round(abs(r), 6) AS abs_target_correlation, round(r, 6) AS target_correlation, round(mi, 6) AS mutual_information
    FROM r JOIN mi ON feature = "column" """,
)
def q_target_associations(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
    out = association.target_associations(holed_lines(spark, sf_dir), "l_returnflag", names)
    return rounded(out, "abs_target_correlation", "target_correlation", "mutual_information")


def anova_sql(c):
    return f"""SELECT '{c}' AS feature, (sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score,
      count(*) - 1 AS df_between, CAST(sum(n) - count(*) AS BIGINT) AS df_within
      FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY l_returnflag), (SELECT avg({c}) AS mu FROM lineitem)"""


@query(
    "anova_f",
    f"""SELECT feature, round(f_score, 5) AS f_score, df_between, df_within FROM ({' UNION ALL '.join(map(anova_sql, NUMERIC_LINES))})""",
)
def q_anova(spark, sf_dir):
    out = association.anova_f(table(spark, sf_dir, "lineitem"), "l_returnflag", NUMERIC_LINES)
    return rounded(out, "f_score", digits=5).drop("p_value", "stars")


NEW_COLUMNS = {
    "o_custkey": ("bigint", True),
    "o_orderstatus": ("string", False),
    "o_totalprice": ("double", True),
    "o_currency": ("string", False),
    "priority_code": ("string", False),
    "o_orderpriority": ("string", False),
}
FULL_NUMBERS = ["o_custkey", "o_totalprice"]
FULL_CELLS = {
    "o_orderstatus": "o_orderstatus",
    "o_currency": "o_currency",
    "priority_code": "priority_code",
}


def full_side(op: str, factor: str, status: str) -> str:
    return f"""(SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey, {status} AS o_orderstatus,
      o_totalprice * {factor} AS o_totalprice, 'EUR' AS o_currency, 'p' || o_orderpriority AS priority_code, o_orderpriority
      FROM orders WHERE o_orderdate {op} TIMESTAMP '1998-01-01')"""


FULL_SIDES = f"""refs AS {full_side('<', '1.0::DOUBLE', 'o_orderstatus')},
  news AS {full_side('>=', '1.25::DOUBLE', "CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE o_orderstatus END")}"""


def shifted_orders(spark, sf_dir):
    """Older orders, and recent orders with a price shift and a status shift."""
    key = F.col("o_orderkey")

    def side(df, factor, status):
        return df.select(
            F.when(key % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
            status.alias("o_orderstatus"),
            (F.col("o_totalprice") * factor).alias("o_totalprice"),
            F.lit("EUR").alias("o_currency"),
            F.concat(F.lit("p"), "o_orderpriority").alias("priority_code"),
            "o_orderpriority",
        )

    old, recent = orders_sides(spark, sf_dir, "*")
    status = F.col("o_orderstatus")
    return side(old, 1.0, status), side(recent, 1.25, F.when(key % 3 == 0, "O").otherwise(status))


@query(
    "complete_validation",
    f"""WITH {FULL_SIDES}, {KS}, cat AS ({chi_sql('o_orderstatus')} UNION ALL {chi_sql('o_currency')} UNION ALL {chi_sql('priority_code')}), {CHI_TAIL},
    report AS (SELECT "column", 'ks' AS test, statistic, p_value < 0.05 AS drifted, NULL::DOUBLE AS total_variation_distance, false AS low_expected_counts FROM ksr
      UNION ALL SELECT "column", 'chi', statistic, statistic > ({CRITICAL})[dof], total_variation_distance, low_expected_counts FROM chi),
    {stats_sql('news', NEW_COLUMNS)} {schema_issue_sql('o_orderpriority', len(NEW_COLUMNS), 'news', NEW_COLUMNS)},
    cells AS ({cells_sql(FULL_CELLS, 'o_orderpriority', 'news')}), {MI_TAIL}, {nearest_sql(filled_cells(FULL_NUMBERS, 'o_orderpriority', 'news'))},
    same AS ({identity_sql([*FULL_CELLS, *FULL_NUMBERS], 'o_orderpriority', 'news')}),
    every AS (SELECT "column", mi FROM mi UNION ALL SELECT "column", mi FROM near),
    scores AS (SELECT "column", CASE WHEN identity_score = 1.0 THEN 1.0::DOUBLE ELSE least(mi / ln((SELECT max(k) FROM mi)), 1.0) END AS score FROM every JOIN same USING ("column"))
    SELECT severity, 'schema' AS category, "column", rule, round(measured, 6) AS measured FROM raw_issues
    UNION ALL SELECT CASE WHEN score > 0.95 THEN 'error' WHEN score >= 0.8 THEN 'warning' ELSE 'info' END, 'leakage', "column",
       CASE WHEN score > 0.95 THEN 'leak_extreme' WHEN score >= 0.8 THEN 'leak_very_strong' ELSE 'leak_strong' END, round(score, 6) FROM scores WHERE score >= 0.6
    UNION ALL SELECT 'warning', 'drift', "column", CASE WHEN test = 'chi' THEN 'category_drift' ELSE 'numeric_drift' END,
       round(CASE WHEN test = 'chi' THEN total_variation_distance ELSE statistic END, 6) FROM report WHERE drifted
    UNION ALL SELECT 'info', 'drift', "column", 'low_expected', NULL FROM report WHERE low_expected_counts""",
)
def q_complete(spark, sf_dir):
    ref, new = shifted_orders(spark, sf_dir)
    out = association.complete_validation(new, "o_orderpriority", "classification", ref)
    return out.select("severity", "category", "column", "rule", F.round("measured", 6).alias("measured"))
