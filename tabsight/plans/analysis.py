"""The whole analysis run (M17, G12, G13): screen → prepare → k-means and DBSCAN → pick →
label, project → optional modelling → findings. Every intermediate is a DataFrame; the
processed feature table is persisted once and shared by both clusterers and the metrics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands as BD
from ..functions.classes import NUMERIC, classify
from ..functions.safe import normalize_missing, qcol
from ..operators import cluster_metrics as CM
from ..operators import dbscan as DB
from ..operators import findings as FD
from ..operators import kmeans as KM
from ..operators import metric_index as MX
from ..operators import neighbors as NB
from ..operators import prep as PR
from ..operators import screen as S
from ..operators import silhouette as SI
from ..operators import stats as ST
from ..operators import train as TR
from ..session import ensure_checkpoint_dir


@dataclass
class ClusteringRun:
    name: str
    labels: DataFrame            # (row_id, cluster)
    metrics: dict
    params: dict


@dataclass
class AnalysisResult:
    status: str
    clean_shape: tuple
    screen: DataFrame | None
    processed: DataFrame
    feature_names: list
    clusterings: dict = field(default_factory=dict)
    best: str | None = None
    settled: bool = True         # the bounds of the silhouettes decide between the clusterings
    labelled: DataFrame | None = None
    pca: DataFrame | None = None
    modeling: TR.ModelingResult | None = None
    findings: DataFrame | None = None
    feature_stats: DataFrame | None = None


def _safe_name(i: int) -> str:
    return f"f{i}"


def cluster_all(processed: DataFrame, names: list[str], kmeans_k: int | None = None, n_init: int = 10,
                methods: tuple = ("KMeans", "DBSCAN"), min_samples: int | None = None, eps: float | None = None) -> dict:
    """M5–M9 on the processed table: both clusterers re-scale the features first (as the
    reference does); metrics use the re-scaled coordinates."""
    cols = [_safe_name(i) for i in range(len(names))]
    flat = processed.select("row_id", *[qcol(n).alias(c) for n, c in zip(names, cols)])
    scaled = KM.standardize(flat, cols, keep=["row_id"]).persist(StorageLevel.MEMORY_AND_DISK)
    runs = {}
    pts = scaled.select("row_id", F.array(*[F.col(c) for c in cols]).alias("features"))
    tree = MX.build(pts)  # for neighbours in many dimensions and for the Euclidean silhouette
    if "KMeans" in methods:
        labels, k, search, cost = KM.kmeans(scaled, cols, k=kmeans_k, n_init=n_init, rescale=False)
        labels = labels.checkpoint()
        m = euclidean(CM.safe_metrics(labels, cols), tree, labels)
        runs["KMeans"] = ClusteringRun("KMeans", labels.select("row_id", "cluster"), {**m, "n_noise": 0},
                                       {"k": k, "inertia": cost, "search": search})
    if "DBSCAN" in methods:
        n = scaled.count()
        ms = min_samples or scaled.select(BD.dbscan_min_samples(F.lit(n))).first()[0]
        wide = tree if len(cols) > NB.GRID_DIMS else None
        e = eps if eps is not None else NB.estimate_eps(pts, ms, tree=wide)[0]
        lab = DB.dbscan(pts, e, ms, wide).select("row_id", "cluster").checkpoint()
        m = euclidean(CM.safe_metrics(scaled.join(lab, "row_id"), cols), tree, lab)
        runs["DBSCAN"] = ClusteringRun("DBSCAN", lab, m, {"eps": e, "min_samples": ms})
    return runs


def euclidean(metrics: dict, tree: MX.Tree, labels: DataFrame) -> dict:
    """The metrics with the Euclidean silhouette, whose bands the findings use: the middle of its interval, beside its
    ends; the squared variant goes by its own name. Where a clustering has no silhouette (-1) it keeps that."""
    found = SI.silhouette(tree, labels) if metrics["silhouette"] != -1 else None
    if found is None:
        return metrics
    return {**metrics, "silhouette_sq": metrics["silhouette"], "silhouette": (found.low + found.high) / 2,
            "silhouette_low": found.low, "silhouette_high": found.high}


def settled(runs: dict) -> bool:
    """Whether no run's silhouette interval reaches into another's: else the choice may turn on the bounds' width."""
    ends = sorted((r.metrics["silhouette_low"], r.metrics["silhouette_high"]) for r in runs.values() if "silhouette_low" in r.metrics)
    return all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def best_run(spark, runs: dict) -> str:
    """The name of the run that ``cluster_metrics.select_best`` selects."""
    if not runs:
        raise ValueError("no clustering finished, so there is none to choose")
    rows = [(name, float(r.metrics["silhouette"]), int(r.metrics["n_clusters"]), int(r.metrics["n_noise"]),
             int(r.metrics["n_rows"]), i) for i, (name, r) in enumerate(runs.items())]
    table = spark.createDataFrame(rows, "model string, raw_sil double, n_clusters long, n_noise long, n_rows long, ord int")
    return CM.select_best(table).where("selected").first()["model"]


def run_analysis(df: DataFrame, target_col: str | None = None, run_modeling: bool = False, auto_clean: bool = True,
                 kmeans_k: int | None = None, n_init: int = 10, methods: tuple = ("KMeans", "DBSCAN")) -> AnalysisResult:
    """The unsupervised run, plus modelling when a present target is given."""
    ensure_checkpoint_dir(df.sparkSession)
    screen = None
    df = normalize_missing(df)
    clean = df
    if auto_clean:
        clean, screen = S.validate_and_clean(df, target_col)
    if len(clean.columns) == 0:
        raise ValueError("No usable features remain after preprocessing")
    prepared = PR.preprocess(clean, target_col=target_col)
    processed = prepared.frame.persist(StorageLevel.MEMORY_AND_DISK)
    names = prepared.feature_names
    runs = cluster_all(processed, names, kmeans_k, n_init, methods)
    best = best_run(df.sparkSession, runs)
    best_labels = runs[best].labels.checkpoint()                             # reused by every report below
    labelled = processed.join(best_labels, "row_id", "left").checkpoint()   # J1: labels back on their rows
    pca_res = PR.pca(processed, names, 2, keep=["row_id"], drop_all_null_rows=True)
    pca = pca_res[0].join(best_labels, "row_id", "left") if pca_res else None
    modeling = None
    if run_modeling and target_col and target_col in df.columns:
        model_input, _ = S.validate_and_clean(df, target_col) if auto_clean else (df, None)
        modeling = TR.train(model_input, target_col)
    quality = report_quality(clean)
    findings = full_report(labelled, quality, runs[best], modeling)
    processed.unpersist()
    return AnalysisResult("success", (clean.count(), len(clean.columns)), screen, processed, names, runs, best, settled(runs),
                          labelled, pca, modeling, findings, feature_statistics(clean))


def _one_row(spark, values: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], schema)


def report_quality(clean: DataFrame) -> DataFrame:
    """One row of the cleaned table's quality, before anything is filled in or scaled: records, missing
    cells in percent, and features (all, numeric, categorical)."""
    kinds = [k for _, k in classify(clean)]
    nulls = sum((F.count_if(qcol(c).isNull()) for c in clean.columns), F.lit(0))
    return clean.agg(F.count(F.lit(1)).alias("n_records"), nulls.alias("nulls")).select(
        F.lit("dataset").alias("subject"), "n_records",
        F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("n_records") * len(kinds)), F.lit(0.0)).alias("missing_pct"),
        F.lit(len(kinds)).alias("n_features"), F.lit(kinds.count(NUMERIC)).alias("n_numeric"),
        F.lit(len(kinds) - kinds.count(NUMERIC)).alias("n_categorical"), F.lit(True).alias("has_clustering"))


def full_report(labelled: DataFrame, quality: DataFrame, run: ClusteringRun,
                modeling: TR.ModelingResult | None) -> DataFrame:
    """Cluster quality and balance (from ``labelled``), model insights, and the data's quality and
    recommendations (from ``quality``, see :func:`report_quality`) — as one findings table."""
    spark = labelled.sparkSession
    m = run.metrics
    sizes = CM.cluster_sizes(labelled, "cluster").agg(
        F.min(F.when(F.col("cluster") != -1, F.col("size"))).alias("min_size"),
        F.max(F.when(F.col("cluster") != -1, F.col("size"))).alias("max_size"),
        F.min("size").alias("all_min_size"), F.max("size").alias("all_max_size"), F.avg("size").alias("avg_size"))
    cm = sizes.select(F.lit(run.name).alias("subject"), F.lit(m["n_clusters"]).cast("long").alias("n_clusters"),
                      F.lit(float(m["silhouette"])).alias("silhouette"), F.lit(m["n_noise"]).cast("long").alias("n_noise"),
                      F.lit(m["n_rows"]).cast("long").alias("n_rows"), "*")
    parts = [FD.run(cm, "subject", FD.CLUSTER_QUALITY, "clustering"),
             FD.run(cm, "subject", FD.CLUSTER_BALANCE, "clustering"),
             FD.run(cm, "subject", FD.CLUSTERING_BUSINESS, "clustering_summary")]
    parts += [FD.run(quality, "subject", FD.DATA_QUALITY, "data_quality"),
              FD.run(quality, "subject", FD.RECOMMEND, "recommendations")]
    if modeling is not None and modeling.all_importances:
        imp = spark.createDataFrame(modeling.all_importances, "feature string, importance double")
        summ = FD.importance_summary(imp).withColumn("subject", F.lit(modeling.best_model_name))
        parts += [FD.run(summ, "subject", FD.DRIVERS, "modeling"), FD.run(summ, "subject", FD.FEATURES_BUSINESS, "features")]
    if modeling is not None:
        cv = modeling.cross_val_scores[modeling.best_model_name]
        import numpy as np
        mm = _one_row(spark, {"subject": modeling.best_model_name, "model_name": modeling.best_model_name,
                              "problem_type": modeling.problem_type, "best_score": float(modeling.best_score),
                              "cv_mean": float(np.mean(cv)), "cv_std": float(np.std(cv)),
                              "n_records": int(modeling.training_data["n_samples"]),
                              "missing_pct": float(quality.first()["missing_pct"]),
                              "top_feature": modeling.feature_importance[0][0] if modeling.feature_importance else None},
                      "subject string, model_name string, problem_type string, best_score double, cv_mean double, "
                      "cv_std double, n_records long, missing_pct double, top_feature string")
        parts += [FD.run(mm, "subject", FD.PERFORMANCE, "modeling"), FD.run(mm, "subject", FD.OPTIMIZATION, "modeling"),
                  FD.run(mm, "subject", FD.MODEL_BUSINESS, "modeling_summary"),
                  FD.run(mm, "subject", FD.NEXT_STEPS, "recommendations_summary")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_statistics(clean: DataFrame) -> DataFrame:
    """A6 part of G12: distribution of every numeric column of the cleaned table, in its own units."""
    return ST.feature_distribution(clean, [c for c, k in classify(clean) if k == NUMERIC])
