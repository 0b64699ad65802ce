"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Simple counts of every text are turned into a short vector.  For each language and source the minimum
covariance determinant estimate is found by concentration steps: the distances of all rows from the present
estimate are put into narrow bins, and the rows of the nearest bins that hold the wanted share give the next
estimate.  A step is one aggregate with map-side combination, so a source with a third of all rows is no
special case, and every row of every group takes part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbrule.core.session import cut_lineage
from plumbrule.llm.source_mix import SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Smallest deviations of the vector's parts: most texts have no symbol or repeated line, and a spread of zero rejects all others.
FLOORS = (0.3, 0.1, 0.25, 0.25, 0.25)
SHARE = 0.75
#: Groups with fewer fitted rows are pooled: first with the same language, then all together.
LEAST_ROWS = 100
STEPS = 12
BIN = 8.0


def _let(value: Column, body) -> Column:
    """Evaluate a value once and use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def _covered(hashes: Column) -> Column:
    """Number of words in windows whose hash stands twice or more in the array."""
    def positions(ordered: Column) -> Column:
        n = F.size(ordered)
        twin = lambda x, j: ((j > 0) & (ordered[F.greatest(j - 1, F.lit(0))]["h"] == x["h"])) | ((j + 1 < n) & (ordered[F.least(j + 1, n - 1)]["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    def union(p: Column) -> Column:
        n = F.size(p)
        width = lambda x, j: F.when(j + 1 < n, F.least(p[F.least(j + 1, n - 1)] - x, F.lit(WINDOW))).otherwise(WINDOW)
        return F.aggregate(F.transform(p, width), F.lit(0).cast("long"), lambda a, x: a + x)

    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(marked, lambda ordered: _let(positions(ordered), union))


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur at least twice in the text, the first ones included."""
    def windows(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(codes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(codes, i, F.lit(WINDOW))))

    found = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda codes: _let(windows(codes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0)),
    )
    return F.when(F.size(words) >= WINDOW, found).otherwise(0).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``; NULL counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return docs.withColumns(
        {
            "_counts": _let(_words(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "_lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))),
        }
    ).withColumns(
        {
            "n_words": F.col("_counts")["n"],
            "n_repeat_words": F.col("_counts")["r"],
            "n_lines": F.col("_lines")["n"].cast("long"),
            "n_dup_lines": F.col("_lines")["d"].cast("long"),
        }
    ).drop("_counts", "_lines")


def statistic_vector() -> list[Column]:
    """Length, word length, and rates of symbols, repeated lines and repeated words, on scales where usual texts look alike."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [
        F.log(words),
        F.log(letters / words),
        F.log(F.col("n_symbols") / letters + 0.01),
        F.log(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) + 0.15),
        F.log(F.col("n_repeat_words") / words + 0.15),
    ]


def chi2_share(x: float, p: int) -> float:
    """Share of a chi-square distribution with p degrees of freedom below x."""
    a, half = p / 2.0, x / 2.0
    term = total = 1.0 / a
    for i in range(1, 500):
        term *= half / (a + i)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if x > 0 else 0.0


def chi2_point(share: float, p: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_share(middle, p) < share else (low, middle)
    return high


def _consistency(share: float, p: int) -> float:
    """Factor that makes the spread of the nearest ``share`` of normal rows that of all."""
    return share / chi2_share(chi2_point(share, p), p + 2)


P = len(FLOORS)
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _distance() -> Column:
    """Squared distance from the joined estimate: centre m0.. and inverse factor w00.. ."""
    out = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        out = out + z * z
    return out


def _sums() -> list[Column]:
    one = F.count(F.lit(1)).cast("double").alias("n")
    return [one, *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS]]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """``grp, rows, m0.., w00.., logdet`` from sums of the chosen rows; the factor widens the covariance."""
    out = sums.select("grp", "rows", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[(F.col(f"q{i}{j}") / F.col("n")).alias(f"q{i}{j}") for i, j in _PAIRS])
    out = out.withColumns({f"c{i}{j}": (F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in _PAIRS})
    for i in range(P):  # Cholesky factor, row by row
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    for i in range(P):  # its inverse
        for j in range(i + 1):
            if i == j:
                value = 1.0 / F.col(f"l{i}{i}")
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                value = value / F.col(f"l{i}{i}")
            out = out.withColumn(f"w{i}{j}", value)
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(P)), F.lit(0.0))
    return out.select("grp", "rows", *[f"m{i}" for i in range(P)], *[f"w{i}{j}" for i, j in _PAIRS], logdet.alias("logdet"))


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile distances of each part, as an uncorrelated first estimate."""
    quartiles = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"p{i}") for i in range(P)]
    table = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), *quartiles)
    spread = [F.sqrt(F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2) for i in range(P)]
    w = [((1.0 / spread[i]) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in _PAIRS]
    return table.select("grp", "rows", *[F.col(f"p{i}")[1].alias(f"m{i}") for i in range(P)], *w, F.lit(None).cast("double").alias("logdet"))


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate from the nearest rows: the bins of distance that are needed to hold ``SHARE`` of a group."""
    near = rows.join(estimate, "grp").withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * BIN).cast("int"))
    bins = near.groupBy("grp", "rows", "bin").agg(*_sums())
    before = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    held = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0.0))).where(F.col("before") < SHARE * F.col("rows"))
    names = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in _PAIRS]]
    return _estimate(held.groupBy("grp", "rows").agg(*[F.sum(c).alias(c) for c in names]), _consistency(SHARE, P))


def _reweight(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate from all rows that the first one does not find far away."""
    inside = rows.join(estimate, "grp").where(_distance() <= chi2_point(0.975, P))
    return _estimate(inside.groupBy("grp", "rows").agg(*_sums()), _consistency(0.975, P))


def fit_groups(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Estimate of every ``grp`` from its rows ``x0..``; the table grows with the groups only."""
    estimate = cut_lineage(_start(rows))
    last = None
    for _ in range(steps):
        estimate = cut_lineage(_concentrate(rows, estimate))
        total = estimate.agg(F.sum("logdet")).first()[0]
        if total is None or (last is not None and abs(total - last) <= 1e-6 * max(1.0, abs(total))):
            break
        last = total
    return cut_lineage(_reweight(rows, estimate))


def _part(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(name).cast("string")))


def _pooled(rows: DataFrame) -> DataFrame:
    """Add ``grp``: language and source, or a pool if these have fewer than ``LEAST_ROWS`` rows fit for an estimate."""
    fit = F.sum((~F.col("base_failed")).cast("int"))
    parts = rows.withColumns({"_l": _part("lang"), "_s": _part("source")})
    small = parts.groupBy("_l", "_s").agg(fit.alias("n"))
    small = small.withColumn("pooled", F.col("n") < LEAST_ROWS)
    pool = small.where("pooled").groupBy("_l").agg((F.sum("n") < LEAST_ROWS).alias("rest"))
    names = small.join(pool, "_l", "left").select(
        "_l", "_s", F.when(~F.col("pooled"), F.concat_ws("\x1f", "_l", "_s")).when(F.col("rest"), F.lit("*")).otherwise(F.concat_ws("\x1f", "_l", F.lit("*"))).alias("grp")
    )
    return parts.join(names, ["_l", "_s"]).drop("_l", "_s")


def robust_quality(
    docs: DataFrame, *, cut: float = 0.99999, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``doc_id, n_words``, the base counts, ``base_failed, distance2, kept`` of every row.

    ``cut`` is the share of a chi-square distribution that the squared distance of a kept text stays within.
    NULL texts are empty and fail the base rule; NULL languages and sources are groups of their own; the
    estimates rest on the rows that pass the base rule.  A pool with fewer than ``2 * P`` such rows judges
    nothing, and its texts are kept.  Repeated rows give repeated rows; other columns play no part; an empty
    table gives an empty result.
    """
    named = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = base_counts(named).drop("text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed).withColumns({f"x{i}": c for i, c in enumerate(statistic_vector())})
    counted = cut_lineage(counted)
    rows = cut_lineage(_pooled(counted))
    estimate = fit_groups(rows.where(~F.col("base_failed")).select("grp", *[f"x{i}" for i in range(P)]))
    judged = rows.join(estimate, "grp", "left").withColumn("distance2", _distance())
    far = F.coalesce((F.col("rows") >= 2 * P) & (F.col("distance2") > chi2_point(cut, P)), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", (~F.col("base_failed") & ~far).alias("kept")
    )
