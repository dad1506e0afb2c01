"""Clustering metrics over a labelled frame.

Everything is computed from per-cluster sufficient statistics — count, coordinate sums and
sum of squared norms — gathered by one ``groupBy(cluster)``; that table has one row per
cluster (k·d numbers, size checked), so it is the only thing that reaches the driver,
exactly as Spark's own ``ClusteringEvaluator`` does. Per-row terms (distance to the own
centroid, silhouette) use the cluster table as literals inside a projection: no join.

Silhouette: the exact Euclidean silhouette is an all-pairs quantity; at scale we compute the
*squared*-Euclidean silhouette exactly in linear time (the distance Spark's evaluator uses):
mean squared distance from x to cluster C is ||x||² − 2·x·S_C/n_C + Q_C/n_C.
Noise (−1) counts as one more cluster, as in the reference; fewer than two non-noise clusters
gives (−1, NULL, NULL).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands as BD
from ..functions.safe import qcol

MAX_CLUSTER_CELLS = 5_000_000  # k × d bound for the per-cluster table kept on the driver


def cluster_sizes(df: DataFrame, label: str = "cluster") -> DataFrame:
    """(cluster, size) by label."""
    return df.groupBy(qcol(label).alias("cluster")).agg(F.count(F.lit(1)).alias("size")).orderBy("cluster")


def cluster_counts(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Clusters (labels ≠ −1) and noise rows."""
    x = qcol(label)
    return df.agg(F.count_distinct(F.when(x != -1, x)).cast("long").alias("n_clusters"),
                  F.count_if(x == -1).cast("long").alias("n_noise"),
                  F.count(F.lit(1)).cast("long").alias("n_rows"))


def cluster_balance(df: DataFrame, label: str = "cluster") -> DataFrame:
    """Average, min, max cluster size and max/min ratio."""
    s = cluster_sizes(df, label)
    return s.agg(F.round(F.avg("size"), 6).alias("avg_size"), F.min("size").alias("min_size"),
                 F.max("size").alias("max_size"),
                 F.round(F.try_divide(F.max("size").cast("double"), F.min("size").cast("double")), 6).alias("size_ratio"))


@dataclass
class ClusterTable:
    ids: list
    n: np.ndarray        # (k,)
    sums: np.ndarray     # (k, d)
    sq: np.ndarray       # (k,)  Σ ||x||²

    @property
    def centroids(self) -> np.ndarray:
        return self.sums / self.n[:, None]


def cluster_table(df: DataFrame, cols: list[str], label: str = "cluster") -> ClusterTable:
    k = df.select(qcol(label)).distinct().count()
    if k * max(1, len(cols)) > MAX_CLUSTER_CELLS:
        raise ValueError(f"{k} clusters x {len(cols)} columns: more than the per-cluster table may hold")
    sqnorm = None
    for c in cols:
        t = qcol(c) * qcol(c)
        sqnorm = t if sqnorm is None else sqnorm + t
    rows = (df.groupBy(qcol(label).alias("cl"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(sqnorm).alias("q"), *[F.sum(qcol(c)).alias(f"s{i}") for i, c in enumerate(cols)])
            .orderBy("cl").collect())
    return ClusterTable(ids=[r["cl"] for r in rows], n=np.array([r["n"] for r in rows], dtype=float),
                        sums=np.array([[r[f"s{i}"] for i in range(len(cols))] for r in rows], dtype=float).reshape(len(rows), len(cols)),
                        sq=np.array([r["q"] for r in rows], dtype=float))


def _with_own_centroid_sq(df: DataFrame, cols: list[str], ct: ClusterTable, label: str) -> DataFrame:
    """Adds ``_d2`` = squared distance to the row's own centroid, by a broadcast hash join with
    the k-row centroid table (size bounded by ``MAX_CLUSTER_CELLS``); the per-row expression
    is O(d), whatever the number of clusters."""
    spark = df.sparkSession
    cent = ct.centroids
    rows = [(cid, [float(v) for v in cent[j]]) for j, cid in enumerate(ct.ids)]
    dtype = dict(df.dtypes)[label]
    ctab = spark.createDataFrame(rows, f"_cl {dtype}, _c array<double>")
    joined = df.join(F.broadcast(ctab), qcol(label) == F.col("_cl"))
    d2 = None
    for i, c in enumerate(cols):
        t = (qcol(c) - F.col("_c")[i]) * (qcol(c) - F.col("_c")[i])
        d2 = t if d2 is None else d2 + t
    return joined.withColumn("_d2", d2).drop("_cl", "_c")


def within_cluster_ss(df: DataFrame, cols: list[str], label: str = "cluster", ct: ClusterTable | None = None) -> float:
    """Inertia Σ ||x − c_label||²."""
    ct = ct or cluster_table(df, cols, label)
    return _with_own_centroid_sq(df, cols, ct, label).agg(F.sum("_d2").alias("w")).first()["w"] or 0.0


def davies_bouldin(df: DataFrame, cols: list[str], label: str = "cluster", ct: ClusterTable | None = None) -> float | None:
    """Mean over clusters of max_j (s_i + s_j) / ||c_i − c_j||."""
    ct = ct or cluster_table(df, cols, label)
    k = len(ct.ids)
    if k < 2:
        return None
    own = _with_own_centroid_sq(df, cols, ct, label)
    s = {r["cl"]: r["s"] for r in own.groupBy(qcol(label).alias("cl")).agg(F.avg(F.sqrt("_d2")).alias("s")).collect()}
    intra = np.array([s[c] for c in ct.ids])
    cent = ct.centroids
    dist = np.sqrt(((cent[:, None, :] - cent[None, :, :]) ** 2).sum(-1))
    if np.allclose(intra, 0) or np.allclose(dist, 0):
        return 0.0
    dist[dist == 0] = np.inf
    comb = intra[:, None] + intra[None, :]
    return float(np.mean(np.max(comb / dist, axis=1)))


def calinski_harabasz(df: DataFrame, cols: list[str], label: str = "cluster", ct: ClusterTable | None = None) -> float | None:
    """(B / (k − 1)) / (W / (n − k))."""
    ct = ct or cluster_table(df, cols, label)
    k = len(ct.ids)
    n = ct.n.sum()
    if k < 2:
        return None
    mean = ct.sums.sum(0) / n
    b = float((ct.n * ((ct.centroids - mean) ** 2).sum(1)).sum())
    w = within_cluster_ss(df, cols, label, ct)
    return 1.0 if w == 0.0 else float(b * (n - k) / (w * (k - 1.0)))


SMALL_SILHOUETTE_CELLS = 256


def silhouette_rows(df: DataFrame, cols: list[str], label: str = "cluster", ct: ClusterTable | None = None) -> DataFrame:
    """Per-row squared-Euclidean silhouette as a projection with the cluster table as literals."""
    ct = ct or cluster_table(df, cols, label)
    norm = None
    for c in cols:
        norm = qcol(c) * qcol(c) if norm is None else norm + qcol(c) * qcol(c)
    dists = []
    for j, cid in enumerate(ct.ids):
        dot = None
        for i, c in enumerate(cols):
            t = qcol(c) * F.lit(float(ct.sums[j, i] / ct.n[j]))
            dot = t if dot is None else dot + t
        dists.append(F.struct(F.lit(cid).alias("cl"), F.lit(float(ct.n[j])).alias("n"),
                              (norm - F.lit(2.0) * dot + F.lit(float(ct.sq[j] / ct.n[j]))).alias("d")))
    arr = F.array(*dists)
    me = F.filter(arr, lambda s: s["cl"] == qcol(label))[0]
    others = F.filter(arr, lambda s: s["cl"] != qcol(label))
    a = F.try_divide(me["d"] * me["n"], me["n"] - F.lit(1.0))
    b = F.array_min(F.transform(others, lambda s: s["d"]))
    sil = F.when(me["n"] <= 1, F.lit(0.0)).otherwise(F.try_divide(b - a, F.greatest(a, b)))
    return df.select("*", F.coalesce(sil, F.lit(0.0)).alias("silhouette"))


def silhouette_sq(df: DataFrame, cols: list[str], label: str = "cluster", ct: ClusterTable | None = None) -> float:
    """Mean squared-Euclidean silhouette. Few clusters × dims: one projection with the cluster
    table as literals; otherwise Spark's ``ClusteringEvaluator`` (same definition, vectorised,
    cluster statistics broadcast)."""
    ct = ct or cluster_table(df, cols, label)
    if len(ct.ids) * max(1, len(cols)) <= SMALL_SILHOUETTE_CELLS:
        return silhouette_rows(df, cols, label, ct).agg(F.avg("silhouette").alias("s")).first()["s"]
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler
    vec = VectorAssembler(inputCols=cols, outputCol="_features").transform(
        df.select(*[qcol(c) for c in cols], qcol(label).cast("double").alias("_pred")))
    ev = ClusteringEvaluator(featuresCol="_features", predictionCol="_pred", metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(vec))


def safe_metrics(df: DataFrame, cols: list[str], label: str = "cluster") -> dict:
    """``(silhouette, davies_bouldin, calinski_harabasz)`` with the reference's guard: fewer than
    two non-noise clusters → (−1, None, None)."""
    ct = cluster_table(df, cols, label)
    valid = [c for c in ct.ids if c != -1]
    n_noise = int(sum(n for c, n in zip(ct.ids, ct.n) if c == -1))
    base = {"n_clusters": len(valid), "n_noise": n_noise, "n_rows": int(ct.n.sum()),
            "inertia": within_cluster_ss(df, cols, label, ct)}
    if len(valid) < 2:
        return {**base, "silhouette": -1.0, "davies_bouldin": None, "calinski_harabasz": None}
    return {**base, "silhouette": silhouette_sq(df, cols, label, ct),
            "davies_bouldin": davies_bouldin(df, cols, label, ct),
            "calinski_harabasz": calinski_harabasz(df, cols, label, ct)}


def select_best(candidates: DataFrame) -> DataFrame:
    """(model, adjusted_score, selected) from (model, raw_sil, n_clusters, n_noise, n_rows,
    ord); the highest adjusted score is selected, the first listed on ties."""
    adj = BD.adjusted_cluster_score(F.col("raw_sil"), F.col("n_clusters"), F.col("n_noise"), F.col("n_rows"))
    w = Window.orderBy(F.desc("adj"), "ord")  # one row a candidate model
    return (candidates.withColumn("adj", adj)
            .select("model", F.round("adj", 6).alias("adjusted_score"), (F.row_number().over(w) == 1).alias("selected")))
