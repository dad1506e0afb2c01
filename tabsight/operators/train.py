"""Supervised training: problem type, model zoo, cross-validation, refit, hold-out metrics,
feature importance (M11–M16, M18, F11, F18, IO4).

* logistic regression, L2, C = 1   → MLlib, ``regParam = 1/(C·n)``, ``standardization=False``, 1000 iterations
* ridge, α = 1                     → MLlib, ``regParam = α·std_pop(y)/n``, ``elasticNetParam=0``,
                                     ``standardization=False``, ``solver="normal"``
* random forests, 100 trees        → ``operators.forest``, no depth bound, seed 42; √features drawn at a
                                     node for classification, all for regression
* gradient boosting, 100 rounds    → ``operators.boosting``, the method of MLlib's ``GBT*(maxIter=100, maxDepth=3,
                                     stepSize=0.1)`` over counted cells; more than two classes → one against
                                     the rest, importances averaged. Where the cells are too many MLlib fits it

The forests of all folds grow in the same passes over the rows, and the boosters of all folds and classes are fitted
from one count of the rows; the MLlib fits of a model and fold are independent Spark jobs from a small driver thread pool over one persisted, fold-labelled feature table. Every
metric of the reference is kept per fold; the first decides.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import CATEGORICAL, classify
from ..functions.safe import qcol
from ..session import ensure_checkpoint_dir
from . import boosting as BO
from . import forest as FO
from . import model_eval as ME
from .knn_impute import NEIGHBORS
from .prep import Preprocessor, blank_to_null, dedupe_rows, filled_by_neighbors, preprocessor_sql_sparse, row_key
from .screen import prep_drop_columns
from .tree_growth import Shape

FOREST, BOOSTING = "RandomForest", "GradientBoosting"
PRIMARY = {"classification": "accuracy", "regression": "r2"}
CLASSIFICATION = "classification"
REGRESSION = "regression"


def detect_problem(df: DataFrame, target: str, threshold: float = 0.05) -> str:
    """F10 on one target column."""
    if dict(classify(df))[target] == CATEGORICAL:
        return CLASSIFICATION
    r = df.agg(F.count_distinct(qcol(target)).alias("d"), F.count(F.lit(1)).alias("n")).first()
    return CLASSIFICATION if r["n"] and r["d"] / r["n"] < threshold else REGRESSION


def make_models(problem: str, n_train: int, n_classes: int, y_std: float | None = None, seed: int = 42) -> dict:
    """The candidates in the reference's order; the forest is grown by ``operators.forest`` (None here)."""
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction"}
    if problem == CLASSIFICATION:
        lr = LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                standardization=False, **common)
        gbt = GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, **common)
        if n_classes > 2:
            gbt = OneVsRest(classifier=GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed,
                                                     featuresCol="features", labelCol="label"), **common)
        return {"LogisticRegression": lr, FOREST: None, BOOSTING: gbt}
    ridge = LinearRegression(regParam=(y_std or 1.0) / max(n_train, 1), elasticNetParam=0.0, standardization=False,
                             solver="normal", **common)
    gbt = GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, **common)
    return {"Ridge": ridge, FOREST: None, BOOSTING: gbt}


def forest_shape(pre: Preprocessor, problem: str, n_classes: int, seed: int = 42, trees: int = 100) -> Shape:
    """100 trees; √features at a node for classification, all for regression."""
    levels = tuple(len(pre.levels[c]) for c in pre.categorical_features)
    width = len(pre.numeric_features) + sum(levels)
    drawn = max(1, math.isqrt(width)) if problem == CLASSIFICATION else max(1, width)
    return Shape(n_classes if problem == CLASSIFICATION else 0, len(pre.numeric_features), levels, drawn, trees, seed)


def packed_rows(data: DataFrame, pre: Preprocessor, **columns: str) -> DataFrame:
    """The rows of the feature table as ``operators.forest`` takes them: level numbers in place of one-hot columns. Whoever
    grows forests of them persists them, so that they are packed once and a task of a later pass holds one Python worker, not two."""
    return FO.pack(data, "row_id", pre.numeric_features, [f"{c}__idx" for c in pre.categorical_features], **columns)


def predicted(votes: DataFrame, problem: str) -> DataFrame:
    """The forest's votes with ``prediction``: the class of most votes (the first of equals), or the mean."""
    v = F.col("votes")
    guess = (F.array_position(v, F.array_max(v)) - 1).cast("double") if problem == CLASSIFICATION else v[0]
    return votes.withColumn("prediction", guess)


def importances(model, n_features: int) -> np.ndarray | None:
    """Tree importances, |coefficients| (mean over classes), OvR averaged."""
    if isinstance(model, BO.BoostedModel):
        return model.importances()
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    if hasattr(model, "models"):
        arrs = [importances(m, n_features) for m in model.models]
        arrs = [a for a in arrs if a is not None]
        return np.mean(arrs, axis=0) if arrs else None
    return None


@dataclass
class ModelingResult:
    problem_type: str
    best_model_name: str
    best_score: float
    all_scores: dict
    cross_val_scores: dict
    feature_importance: list          # [(feature, importance)] top 5, descending
    all_importances: list             # [(feature, importance)] every feature
    metrics: dict
    training_data: dict
    performance_band: str
    model: "FittedModel | None" = None
    label_levels: list = field(default_factory=list)
    errors: dict = field(default_factory=dict)
    fold_metrics: dict = field(default_factory=dict)   # model -> a dict of metrics per fold

    def run_facts(self, spark) -> DataFrame:
        """One row of what the run trained on and what it chose."""
        t = self.training_data
        row = (self.problem_type, t["n_samples"], t["n_features"], t["target_encoded"], len(self.label_levels),
               self.best_model_name, float(self.best_score), self.performance_band)
        return spark.createDataFrame([row], "problem_type string, n_samples long, n_features long, target_encoded boolean, "
                                     "n_classes long, best_model string, best_score double, performance_band string")

    def cv_scores(self, spark) -> DataFrame:
        """One row per model, fold and metric; ``is_primary`` marks the metric that chose the model."""
        rows = [(m, f, name, float(v), name == PRIMARY[self.problem_type], m == self.best_model_name)
                for m, per in self.fold_metrics.items() for f, metrics in enumerate(per) for name, v in metrics.items()]
        return spark.createDataFrame(rows, "model string, fold int, metric string, score double, is_primary boolean, is_best boolean")


@dataclass
class FittedModel:
    """IO4 / F11: preprocessing, model (an MLlib model or a forest) and the labels that class numbers stand for."""

    features: PipelineModel
    model: object
    pre_numeric: list
    pre_categorical: list
    problem: str
    label_levels: list

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and, for classes, ``predicted_label``. Equal rows are scored once."""
        cols = list(df.columns)
        keyed = df.withColumn("row_id", row_key(cols)).withColumn("label", F.lit(0.0))
        wide = self.features.transform(keyed.select(*[qcol(c) for c in cols if c not in ("row_id", "label")], "row_id", "label")
                                       .dropDuplicates(["row_id"]))
        if isinstance(self.model, FO.ForestModel):
            rows = FO.pack(wide, "row_id", self.pre_numeric, [f"{c}__idx" for c in self.pre_categorical])
            found = predicted(self.model.predict(rows), self.problem).select(F.lower(F.hex("id")).alias("row_id"), "prediction")
        else:
            found = self.model.transform(wide).select("row_id", "prediction")
        out = keyed.drop("label").join(found, "row_id").drop("row_id")
        return ME.label_names(out, self.label_levels) if self.problem == CLASSIFICATION else out

    def save(self, path: str) -> None:
        spark = _active()
        self.features.write().overwrite().save(f"{path}/features")
        kind = "forest" if isinstance(self.model, FO.ForestModel) else "boosted" if isinstance(self.model, BO.BoostedModel) else "mllib"
        if kind == "forest":
            self.model.save(f"{path}/forest")
        elif kind == "boosted":
            spark.createDataFrame([(self.model.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/boosted")
        else:
            PipelineModel(stages=[self.model]).write().overwrite().save(f"{path}/mllib")
        facts = {"kind": kind, "numeric": self.pre_numeric, "categorical": self.pre_categorical, "problem": self.problem,
                 "labels": self.label_levels}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark, path: str) -> "FittedModel":
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        model = (FO.ForestModel.load(spark, f"{path}/forest") if facts["kind"] == "forest"
                 else BO.BoostedModel.loads(spark.read.text(f"{path}/boosted").first()["value"]) if facts["kind"] == "boosted"
                 else PipelineModel.load(f"{path}/mllib").stages[0])
        return cls(PipelineModel.load(f"{path}/features"), model, facts["numeric"], facts["categorical"], facts["problem"], facts["labels"])


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def _new_path(spark, name: str) -> str:
    """A folder of its own under the shared folder that the cluster names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{name}-{uuid.uuid4().hex}"


def prepare_supervised(df: DataFrame, target: str, exclude_cols: list[str] | None = None, use_knn: bool = False):
    """M3: blank → NULL → dedupe (target included) → drop rows with a NULL target → features.
    Returns (base frame with row_id and label, fitted preprocessor, problem type, label levels)."""
    base = dedupe_rows(blank_to_null(df))
    ensure_checkpoint_dir(df.sparkSession)
    base = base.withColumn("row_id", row_key(list(df.columns))).where(qcol(target).isNotNull()).checkpoint()
    problem = detect_problem(base, target)
    drop = prep_drop_columns(df, exclude_cols, target)
    feats = [c for c in df.columns if c not in drop]
    if use_knn:
        base = filled_by_neighbors(base, feats, NEIGHBORS)
    pre = Preprocessor(use_knn_imputer=use_knn).fit(base.select(*[qcol(c) for c in feats]))
    levels = []
    if problem == CLASSIFICATION:
        levels = [r["value"] for r in ME.label_index(base, target).orderBy("index").collect()]
        idx = F.array_position(F.array(*[F.lit(v) for v in levels]), qcol(target).cast("string")) - 1
        base = base.withColumn("label", idx.cast("double"))
    else:
        base = base.withColumn("label", qcol(target).cast("double"))
    return base, pre, problem, levels


def feature_pipeline(pre: Preprocessor, keep: list[str]) -> list:
    """Saveable stages: a SQL stage (impute + scale numeric, impute categorical), then per
    categorical column a ``StringIndexerModel`` built from the fitted sorted levels (no extra
    pass; unseen → the dropped last slot) and one ``OneHotEncoder`` giving *sparse* vectors,
    then the assembler. Vector slots follow ``pre.feature_names()``."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
    cats = pre.categorical_features
    sql = SQLTransformer(statement=preprocessor_sql_sparse(pre, keep))
    stages = [sql]
    inputs = list(pre.numeric_features)
    if cats:
        for c in cats:
            stages.append(StringIndexerModel.from_labels(pre.levels[c], inputCol=c, outputCol=f"{c}__idx",
                                                         handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cats], outputCols=[f"{c}__ohe" for c in cats],
                                    dropLast=True))
        inputs += [f"{c}__ohe" for c in cats]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def fit_forest(data: DataFrame, pre: Preprocessor, shape: Shape) -> FO.ForestModel:
    """A forest over all rows of the feature table."""
    rows = packed_rows(data, pre, label="label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return FO.grow_forest(rows, shape, _new_path(data.sparkSession, "forest"))
    finally:
        rows.unpersist()


def fit_boosters(data: DataFrame, pre: Preprocessor, n_classes: int, fits: list[FO.Fit], fold: str = "fold") -> dict | None:
    """Boosters of some fits (see ``operators.boosting``), or None where the rows make too many cells."""
    cats = pre.categorical_features
    return BO.fit(data, pre.numeric_features, [f"{c}__idx" for c in cats], [len(pre.levels[c]) for c in cats], n_classes, fits, fold)


def forest_importances(model: FO.ForestModel, width: int) -> np.ndarray:
    out = np.zeros(width)
    for r in model.importances().collect():  # a row per feature
        out[r["feature"]] = r["importance"]
    return out


def _per_fold(metrics: DataFrame, k: int) -> list[dict]:
    rows = {r["fold"]: r.asDict() for r in metrics.collect()}
    return [{m: float(v) for m, v in rows[f].items() if m != "fold"} for f in range(k)]


def train(df: DataFrame, target: str, exclude_cols: list[str] | None = None, n_splits: int = 5, seed: int = 42,
          threads: int = 6, trees: int = 100, use_knn: bool = False) -> ModelingResult:
    """Cross-validate three models, refit the best on everything, hold-out metrics."""
    base, pre, problem, levels = prepare_supervised(df, target, exclude_cols, use_knn)
    feat_model = Pipeline(stages=feature_pipeline(pre, ["row_id", "label"])).fit(base)
    coded = [f"{c}__idx" for c in pre.categorical_features]
    data = feat_model.transform(base).select("row_id", "label", "features", *[qcol(c) for c in pre.numeric_features + coded])
    counts = {r[0]: r[1] for r in data.groupBy("label").count().collect()} if problem == CLASSIFICATION else {}
    n = base.count()
    k = ME.n_splits_for(counts, problem, n_splits, n)
    folds = ME.assign_folds(data, "row_id", "label" if problem == CLASSIFICATION else None, k, seed)
    folds = folds.persist(StorageLevel.MEMORY_AND_DISK)
    names = pre.feature_names()
    shape = forest_shape(pre, problem, len(counts), seed, trees)
    try:
        by_fold = folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("s"),
                                            F.sum(F.col("label") * F.col("label")).alias("q")).collect()

        def models_without(f=None):  # penalties from the rows that are fitted
            m, s, q = (sum(float(r[c] or 0) for r in by_fold if r["fold"] != f) for c in ("n", "s", "q"))
            spread = max(q / m - (s / m) ** 2, 0.0) ** 0.5 if problem == REGRESSION and m else None
            return make_models(problem, int(m), len(counts), spread, seed)

        def fit_fold(task):
            name, f = task
            fitted = models_without(f)[name].fit(folds.where(F.col("fold") != f))
            return _per_fold(ME.fold_metrics(fitted.transform(folds.where(F.col("fold") == f)).select(
                F.lit(0).alias("fold"), "label", "prediction"), problem), 1)[0]

        def fit_forests():
            rows = packed_rows(folds, pre, label="label", fold="fold").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                votes = FO.cross_predict(rows, [FO.Fit(f, f) for f in range(k)], shape)
                return _per_fold(ME.fold_metrics(predicted(votes, problem), problem, "fit", "y"), k)
            finally:
                rows.unpersist()

        def fit_boosted():
            fitted = fit_boosters(folds, pre, len(counts), [*(FO.Fit(f, f) for f in range(k)), FO.Fit(k)])
            if fitted is None:
                return [fit_fold((BOOSTING, f)) for f in range(k)], None
            scored = reduce(DataFrame.unionAll, [fitted[f].transform(folds.where(F.col("fold") == f)).select("fold", "label", "prediction")
                                                 for f in range(k)])
            return _per_fold(ME.fold_metrics(scored, problem), k), fitted[k]

        order = list(make_models(problem, n, len(counts), 1.0, seed))
        results, errors, boosted = {}, {}, None
        with ThreadPoolExecutor(max_workers=threads) as ex:
            futs = {FOREST: [ex.submit(fit_forests)], BOOSTING: [ex.submit(fit_boosted)]}
            futs |= {name: [ex.submit(fit_fold, (name, f)) for f in range(k)] for name in order if name not in futs}
            for name in order:
                try:
                    got = [fu.result() for fu in futs[name]]
                    if name == BOOSTING:
                        got[0], boosted = got[0]
                    results[name] = got[0] if name in (FOREST, BOOSTING) else got
                except Exception as exc:  # noqa: BLE001 - a failing model is skipped, as in the reference
                    errors[name] = str(exc)[:300]
        if not results:
            raise ValueError("Could not train any models successfully")
        cv = {name: [m[PRIMARY[problem]] for m in results[name]] for name in order if name in results}
        all_scores = {name: float(np.mean(v)) for name, v in cv.items()}
        best = max(cv, key=lambda m: (all_scores[m], -order.index(m)))
        final = (fit_forest(folds, pre, shape) if best == FOREST else boosted if best == BOOSTING and boosted
                 else models_without()[best].fit(folds))
        imp = forest_importances(final, len(names)) if best == FOREST else importances(final, len(names))
        all_imp = []
        if imp is not None:
            fn = names if len(names) == len(imp) else [f"Feature_{i}" for i in range(len(imp))]
            all_imp = sorted(zip(fn, [float(x) for x in imp]), key=lambda t: -t[1])
        # hold-out 80/20 with a fresh fit of the best model
        split = ME.holdout(folds.drop("fold"), "row_id", "label" if problem == CLASSIFICATION and
                           min(counts.values()) >= 2 else None, 0.2, seed).persist(StorageLevel.MEMORY_AND_DISK)
        if best == FOREST:
            rows = packed_rows(split, pre, label="label", marked="is_test").persist(StorageLevel.MEMORY_AND_DISK)
            pred = predicted(FO.cross_predict(rows, [FO.Fit(0, holdout=True)], shape), problem).select(
                F.col("y").alias("label"), "prediction", "votes").persist(StorageLevel.MEMORY_AND_DISK)
        elif best == BOOSTING and boosted and (fitted := fit_boosters(split.withColumn("side", F.col("is_test").cast("int")), pre, len(counts),
                                                                      [FO.Fit(0, 1)], "side")):
            pred = fitted[0].transform(split.where(F.col("is_test")))
            if "probability" in pred.columns:
                pred = pred.withColumnRenamed("probability", "votes")
        else:
            tr = split.where(~F.col("is_test"))
            spread = tr.agg(F.stddev_pop("label")).first()[0] if problem == REGRESSION else None
            fitted = make_models(problem, tr.count(), len(counts), spread, seed)[best].fit(tr)
            pred = fitted.transform(split.where(F.col("is_test")))
            if "probability" in pred.columns:
                pred = pred.withColumn("votes", vector_to_array("probability"))
        if problem == CLASSIFICATION:
            metrics = ME.classification_metrics(pred).first().asDict()
            if len(counts) == 2 and "votes" in pred.columns:
                metrics["roc_auc"] = ME.roc_auc(pred.withColumn("score", F.col("votes")[1]))
        else:
            metrics = ME.regression_metrics(pred).first().asDict()
        fitted_model = FittedModel(feat_model, final, pre.numeric_features, pre.categorical_features, problem, levels)
        return ModelingResult(problem_type=problem, best_model_name=best, best_score=all_scores[best],
                              all_scores=all_scores, cross_val_scores=cv, feature_importance=all_imp[:5],
                              all_importances=all_imp, metrics=metrics,
                              training_data={"n_samples": n, "n_features": len(names), "target_encoded": problem == CLASSIFICATION},
                              performance_band=("weak" if all_scores[best] < 0.6 else "moderate" if all_scores[best] <= 0.75 else "strong"),
                              model=fitted_model, label_levels=levels, errors=errors,
                              fold_metrics={name: results[name] for name in cv})
    finally:
        folds.unpersist()


def save_model(result: ModelingResult, directory: str, target: str) -> str:
    """IO4: preprocessing, model and labels under a name derived from target and model."""
    from ..functions.names import model_filename
    path = f"{directory.rstrip('/')}/{model_filename(target, result.best_model_name)}"
    result.model.save(path)
    return path


def ridge_closed_form(df: DataFrame, x: str, y: str, alpha: float = 1.0):
    """Ridge on one feature via MLlib, mapped as in the module docstring."""
    data = VectorAssembler(inputCols=[x], outputCol="features").transform(
        df.select(qcol(x).cast("double").alias(x), qcol(y).cast("double").alias("label")))
    st = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    lr = LinearRegression(regParam=alpha * st["s"] / st["n"], elasticNetParam=0.0, standardization=False,
                          solver="normal", featuresCol="features", labelCol="label")
    m = lr.fit(data)
    return float(m.coefficients[0]), float(m.intercept)
