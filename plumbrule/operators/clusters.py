"""Centroid clustering, mixtures and cluster quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbrule.core.frames import quoted
from plumbrule.core.moments import moments
from plumbrule.core.session import cut_lineage
from plumbrule.operators.lloyd import labelled, many_kmeans, many_labelled
from plumbrule.operators.neighbours import mean_silhouettes

MAX_CENTRES = 2_000


def centroids(points: DataFrame, width: int) -> DataFrame:
    """``label, n, centre`` of rows ``id, v, label``."""
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("v")[i]) for i in range(width)]).alias("centre"))


def squared_gap(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``id, nearest, distance``: closest centre of each row (smallest label on a tie).

    The centres (at most ``MAX_CENTRES``) reach the rows as one array from a scalar subquery.
    """
    few = centres.agg(
        F.when(F.count(F.lit(1)) > MAX_CENTRES, F.raise_error(F.lit("too many centres"))).otherwise(F.sort_array(F.collect_list(F.struct("label", "centre")))).alias("c")
    )
    rows = points.withColumn("_c", few.scalar())
    best = F.array_min(F.transform("_c", lambda c: F.struct(squared_gap(F.col("v"), c["centre"]).alias("d"), c["label"].alias("label"))))
    return rows.select("*", best.alias("_best")).select("id", F.col("_best.label").alias("nearest"), F.sqrt("_best.d").alias("distance"))


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="skip").transform(df)


def kmeans(df: DataFrame, features: Sequence[str], k: int, n_init: int = 10, init: str = "k-means||", seed: int = 42, max_iter: int = 300):
    """Best of ``n_init`` Lloyd runs by inertia, and the run table ``(seed, inertia)``."""
    data = assemble(df, features).select("features").cache()
    try:
        runs = []
        for s in range(seed, seed + n_init):
            model = KMeans(k=k, initMode=init, seed=s, maxIter=max_iter, featuresCol="features").fit(data)
            runs.append((model.summary.trainingCost, s, model))
        best = min(runs, key=lambda r: (r[0], r[1]))
        return best[2], [(s, cost) for cost, s, _ in runs]
    finally:
        data.unpersist()


def gaussian_mixture(df: DataFrame, features: Sequence[str], k: int, seed: int = 42, max_iter: int = 100, tol: float = 1e-3):
    """Fitted mixture and its mean log-likelihood; one component is the closed-form Gaussian (no model object)."""
    if k == 1:
        m = moments(df, features)
        _, log_det = np.linalg.slogdet(m.scatter / m.n)
        return None, float(-0.5 * (len(features) * (np.log(2 * np.pi) + 1) + log_det))
    data = assemble(df, features).select("features").cache()
    try:
        model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features").fit(data)
        return model, model.summary.logLikelihood / data.count()
    finally:
        data.unpersist()


def mixture_criteria(df: DataFrame, features: Sequence[str], ks: Sequence[int], seed: int = 42) -> DataFrame:
    """AIC and BIC of full-covariance mixtures."""
    d, n, rows = len(features), df.dropna("any", subset=list(features)).count(), []
    for k in ks:
        _, mean_ll = gaussian_mixture(df, features, k, seed)
        free = k * d + k * d * (d + 1) / 2 + k - 1
        rows.append((k, float(mean_ll), float(2 * free - 2 * mean_ll * n), float(free * np.log(n) - 2 * mean_ll * n)))
    return df.sparkSession.createDataFrame(rows, "k int, mean_log_likelihood double, aic double, bic double")


def cluster_features(df: DataFrame, features: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Append the one-hot K-means cluster and the mixture responsibilities as array columns."""
    km, _ = kmeans(df, features, k, 1, seed=seed)
    gm, _ = gaussian_mixture(df, features, k, seed)
    out = gm.setProbabilityCol("_p").setPredictionCol("_g").transform(km.setPredictionCol("_k").transform(assemble(df, features)))
    hot = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("_k")).cast("double"))
    return out.withColumns({"cluster_onehot": hot, "responsibilities": vector_to_array("_p")}).drop("_p", "_g", "_k", "features")


def internal_quality(points: DataFrame, width: int) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of ``id, v, label``; only the centres reach the driver."""
    cents = centroids(points, width)
    rows = cents.limit(MAX_CENTRES + 1).collect()
    if len(rows) > MAX_CENTRES:
        raise ValueError("too many clusters")
    by_label = F.create_map(*[x for r in rows for x in (F.lit(r["label"]), F.array(*map(F.lit, r["centre"])))])
    gap = squared_gap(F.col("v"), by_label[F.col("label")])
    spread = {r["label"]: r for r in points.groupBy("label").agg(F.avg(F.sqrt(gap)).alias("s"), F.sum(gap).alias("ss")).collect()}
    labels = sorted(r["label"] for r in rows)
    c = {r["label"]: np.array(r["centre"]) for r in rows}
    size = {r["label"]: r["n"] for r in rows}
    n, k = sum(size.values()), len(labels)
    mean = sum(size[g] * c[g] for g in labels) / n
    between = sum(size[g] * float(np.sum((c[g] - mean) ** 2)) for g in labels)
    within = sum(spread[g]["ss"] for g in labels)
    worst = [max((spread[a]["s"] + spread[b]["s"]) / float(np.linalg.norm(c[a] - c[b])) for b in labels if b != a) for a in labels]
    out = [(float(np.mean(worst)), float(between / within * (n - k) / (k - 1)), k)]
    return points.sparkSession.createDataFrame(out, "davies_bouldin double, calinski_harabasz double, clusters int")


def external_quality(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Adjusted Rand index, mutual-information scores and V-measure from the contingency table."""
    cells = df.groupBy(F.col(quoted(truth)).alias("t"), F.col(quoted(found)).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    levels = cells.groupingSets([["t", "c"], ["t"], ["c"]], "t", "c").agg(F.sum("n").alias("n"), F.grouping("t").alias("gt"), F.grouping("c").alias("gc"))
    n, pairs, w = F.col("n"), F.col("n") * (F.col("n") - 1) / 2, F.col("n") * F.ln("n")
    joint, rows, cols = (F.col("gt") + F.col("gc")) == 0, F.col("gc") == 1, F.col("gt") == 1

    def total(which, what):
        return F.sum(F.when(which, what).otherwise(0.0))

    s = levels.agg(
        total(joint, n).alias("n"), *[total(g, pairs).alias(f"p{a}") for g, a in ((joint, "j"), (rows, "t"), (cols, "c"))],
        *[total(g, w).alias(f"w{a}") for g, a in ((joint, "j"), (rows, "t"), (cols, "c"))],
    )
    every = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("pt") * F.col("pc") / every
    half = (F.col("pt") + F.col("pc")) / 2
    s = s.withColumns(
        {
            "ari": F.coalesce(F.try_divide(F.col("pj") - expected, half - expected), F.lit(1.0)),
            "mi": F.greatest((F.col("wj") - F.col("wt") - F.col("wc")) / F.col("n") + F.ln("n"), F.lit(0.0)),
            "ht": F.ln("n") - F.col("wt") / F.col("n"),
            "hc": F.ln("n") - F.col("wc") / F.col("n"),
        }
    )
    one = F.lit(1.0)
    return s.select(
        "ari",
        F.coalesce(F.try_divide(F.col("mi"), (F.col("ht") + F.col("hc")) / 2), one).alias("nmi"),
        F.when(F.col("ht") > 0, F.col("mi") / F.col("ht")).otherwise(one).alias("homogeneity"),
        F.when(F.col("hc") > 0, F.col("mi") / F.col("hc")).otherwise(one).alias("completeness"),
        F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ht") + F.col("hc")), one).alias("v_measure"),
    )


def micro_linkage(df: DataFrame, features: Sequence[str], micro: int, clusters: int, linkage: str = "ward", seed: int = 42) -> DataFrame:
    """Agglomerative clustering of K-means micro-clusters: ``micro, n, cluster`` (a few hundred centres)."""
    if micro > MAX_CENTRES:
        raise ValueError(f"at most {MAX_CENTRES} micro-clusters")
    model, _ = kmeans(df, features, micro, 1, seed=seed)
    sizes = {r["prediction"]: r["count"] for r in model.transform(assemble(df, features)).groupBy("prediction").count().collect()}
    centres = model.clusterCenters()
    groups = {i: [i] for i in sizes}
    c = {i: np.array(centres[i]) for i in sizes}
    n = {i: float(sizes[i]) for i in sizes}

    def gap(a: int, b: int) -> float:
        if linkage == "ward":
            return float(np.sum((c[a] - c[b]) ** 2)) * n[a] * n[b] / (n[a] + n[b])
        d = [float(np.linalg.norm(centres[i] - centres[j])) for i in groups[a] for j in groups[b]]
        w = [sizes[i] * sizes[j] for i in groups[a] for j in groups[b]]
        return {"single": min(d), "complete": max(d), "average": float(np.average(d, weights=w))}[linkage]

    near = {(a, b): gap(a, b) for a in groups for b in groups if a < b}
    while len(groups) > clusters:
        a, b = min(near, key=lambda p: (near[p], p))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        groups[a] += groups.pop(b)
        near = {p: v for p, v in near.items() if b not in p and a not in p}
        near.update({(min(a, o), max(a, o)): gap(min(a, o), max(a, o)) for o in groups if o != a})
    rows = [(int(m), int(sizes[m]), k) for k, g in enumerate(sorted(groups, key=lambda g: min(groups[g]))) for m in sorted(groups[g])]
    return df.sparkSession.createDataFrame(rows, "micro int, n long, cluster int")


def _sweep(df: DataFrame, features: Sequence[str], key: str, max_k: int, starts: int, seed: int) -> tuple[DataFrame, int, DataFrame, DataFrame, np.ndarray]:
    """(table of inertia and silhouette per k, best k, scaled rows, their points, centres at the best k)."""
    from plumbrule.operators.prep import standard_scale

    rows = df.dropna("any", subset=list(features))
    n = rows.count()
    if n < 4:
        raise ValueError("clustering needs at least four complete rows")
    scaled = standard_scale(rows, features)
    vector = F.array(*[F.col(quoted(c)).cast("double") for c in features])
    points = cut_lineage(scaled.select(F.col(quoted(key)).alias("id"), vector.alias("v")))
    found = many_kmeans(points, range(2, max(2, min(max_k, n - 1)) + 1), starts, seed)
    # centres that fell together are one cluster, and a k with one cluster scores -1
    split = [k for k, runs in found.items() if len(runs[0][1]) > 1]
    chosen = [found[k][0][1] for k in split]
    scores = dict.fromkeys(found, -1.0)
    if split:
        scores |= dict(zip(split, mean_silhouettes(many_labelled(points, chosen), [len(c) for c in chosen])))
    out = [(k, float(runs[0][0]), float(scores[k])) for k, runs in found.items()]
    best = max(scores, key=lambda k: (scores[k], -k))
    sweep = df.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double")
    return sweep.withColumn("best", F.col("k") == best).orderBy(F.desc("silhouette"), "k"), best, scaled, points, found[best][0][1]


def cluster_analysis(df: DataFrame, features: Sequence[str], key: str, max_k: int = 10, starts: int = 10, seed: int = 42) -> DataFrame:
    """Inertia of the best start and exact silhouette per k on scaled columns, best k first.

    All starts of all k share their passes over the table.  A k whose clusters all fall together scores -1.
    """
    return _sweep(df, features, key, max_k, starts, seed)[0]


def cluster_report(df: DataFrame, features: Sequence[str], key: str, max_k: int = 10, starts: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(the table of ``cluster_analysis``, ``id, kmeans, mixture, responsibilities`` of every row at the best k).

    Rows with a missing feature teach nothing and have NULL labels.
    """
    sweep, best, scaled, points, centres = _sweep(df, features, key, max_k, starts, seed)
    mixture, _ = gaussian_mixture(scaled, features, best, seed)
    soft = mixture.setProbabilityCol("_p").setPredictionCol("_g").transform(assemble(scaled, features))
    soft = soft.select(F.col(quoted(key)).alias("id"), F.col("_g").alias("mixture"), vector_to_array("_p").alias("responsibilities"))
    hard = labelled(points, centres).select("id", F.col("label").alias("kmeans"))
    labels = df.select(F.col(quoted(key)).alias("id")).join(hard, "id", "left").join(soft, "id", "left")
    return sweep, labels
