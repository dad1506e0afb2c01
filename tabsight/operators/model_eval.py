"""Model evaluation and data splitting (A23–A26, F10–F12, M10, M15 split).

Metrics are plain aggregates over a ``(label, prediction[, score])`` frame: a confusion-count
``groupBy`` for the weighted classification metrics, sums for regression, and MLlib's exact
``BinaryClassificationEvaluator(numBins=0)`` for ROC AUC (a distributed sort, ties grouped).

Folds and the hold-out split need an exact rank of rows inside each class in a pseudo-random
order (``md5(seed|row_id)``). A window partitioned by class would put a whole class — possibly
a third of the table — into one task, so ``rank_within`` ranks distributedly instead:
range-partition on (class, hash), rank inside each partition, and add per-(partition, class)
offsets computed from a table of #partitions × #classes counts.
"""

from __future__ import annotations

import math

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import qcol
from ..session import ensure_checkpoint_dir

R = 6


# ------------------------------------------------------------------ classification / regression metrics


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (0 where undefined)."""
    conf = df.groupBy(qcol(label).alias("t"), qcol(prediction).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    tp = conf.where(F.col("t") == F.col("p")).select(F.col("t").alias("cls"), F.col("c").alias("tp"))
    sup = conf.groupBy(F.col("t").alias("cls")).agg(F.sum("c").alias("support"))
    pred = conf.groupBy(F.col("p").alias("cls")).agg(F.sum("c").alias("npred"))
    per = (sup.join(pred, "cls", "full").join(tp, "cls", "left")
           .select("cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("npred", F.lit(0)).alias("npred"),
                   F.coalesce("tp", F.lit(0)).alias("tp")))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = per.select("*", prec.alias("prec"), rec.alias("rec"))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec")), F.lit(0.0))
    per = per.select("*", f1.alias("f1"))
    n = F.sum("support").cast("double")
    return per.agg(
        F.round(F.try_divide(F.sum("tp").cast("double"), n), R).alias("accuracy"),
        F.round(F.try_divide(F.sum(F.col("support") * F.col("f1")), n), R).alias("f1"),
        F.round(F.try_divide(F.sum(F.col("support") * F.col("prec")), n), R).alias("precision"),
        F.round(F.try_divide(F.sum(F.col("support") * F.col("rec")), n), R).alias("recall"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> float | None:
    """A23 (binary only): exact area under ROC; ties in score count half."""
    two = df.select(qcol(label)).distinct().limit(3).count()
    if two != 2:
        return None
    data = df.select(qcol(label).cast("double").alias("label"), qcol(score).cast("double").alias("rawPrediction"))
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction",
                                       metricName="areaUnderROC", numBins=0)
    return float(ev.evaluate(data))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       digits: int | None = R) -> DataFrame:
    """RMSE, MAE, R² (R² = 1 when both sums of squares are 0, 0 when only the total is); ``digits`` None: not rounded."""
    shown = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    y, p = qcol(label).cast("double"), qcol(prediction).cast("double")
    m = df.agg(F.avg(y).alias("ybar")).first()["ybar"]
    agg = df.agg(F.sum((y - p) * (y - p)).alias("ssr"), F.sum(F.abs(y - p)).alias("sae"),
                 F.sum((y - F.lit(m)) * (y - F.lit(m))).alias("sst"), F.count(F.lit(1)).alias("n"))
    r2 = (F.when(F.col("sst") == 0, F.when(F.col("ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("ssr") / F.col("sst")))
    return agg.select(shown(F.sqrt(F.try_divide(F.col("ssr"), F.col("n").cast("double")))).alias("rmse"),
                      shown(F.try_divide(F.col("sae"), F.col("n").cast("double"))).alias("mae"),
                      shown(r2).alias("r2"))


def fold_metrics(df: DataFrame, problem: str, fold: str = "fold", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every metric of every fold in one pass, not rounded. Classification: ``accuracy`` and support-weighted
    ``f1``, ``precision`` and ``recall``; regression: ``r2``, ``mse`` and ``mae``, as in A23 and A24."""
    if problem != "classification":
        y, p = qcol(label).cast("double"), qcol(prediction).cast("double")
        n, total = F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("spread")
        sums = df.groupBy(qcol(fold).alias("fold")).agg(n, total, F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"))
        r2 = F.when(F.col("spread") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide("mse", "spread"))
        return sums.select("fold", r2.alias("r2"), "mse", "mae")
    cells = df.groupBy(qcol(fold).alias("fold"), qcol(label).cast("double").alias("t"), qcol(prediction).cast("double").alias("p")).count()
    hit = F.when(F.col("t") == F.col("p"), F.col("count")).otherwise(0)
    sides = cells.select("fold", F.explode(F.array(
        F.struct(F.col("t").alias("cls"), F.col("count").alias("support"), F.lit(0).cast("long").alias("guessed"), hit.alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("count").alias("guessed"), F.lit(0).cast("long").alias("hit")))).alias("s"))
    per = sides.groupBy("fold", "s.cls").agg(F.sum("s.support").alias("support"), F.sum("s.guessed").alias("guessed"), F.sum("s.hit").alias("hit"))
    precision, recall = F.coalesce(F.try_divide("hit", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))
    n = F.sum("support")
    return per.groupBy("fold").agg(
        F.try_divide(F.sum("hit"), n).alias("accuracy"), F.try_divide(F.sum(F.col("support") * f1), n).alias("f1"),
        F.try_divide(F.sum(F.col("support") * precision), n).alias("precision"), F.try_divide(F.sum(F.col("support") * recall), n).alias("recall"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and whether it is the rarest."""
    c = df.groupBy(qcol(label).alias("cls")).agg(F.count(F.lit(1)).alias("count"))
    mn = c.agg(F.min("count").alias("m")).first()["m"]
    return c.select("cls", "count", (F.col("count") == F.lit(mn)).alias("rarest"))


def fold_stability(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Per model mean, population std and coefficient of variation (0 when mean ≤ 0)."""
    g = scores.groupBy(qcol(model).alias("model")).agg(F.avg(qcol(score)).alias("mean"), F.stddev_pop(qcol(score)).alias("std"))
    return g.select("model", F.round("mean", R).alias("mean_score"), F.round("std", R).alias("std_score"),
                    F.round(F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)), R).alias("cv"))


# ------------------------------------------------------------------ problem type, label encoding


def problem_type_col(is_string: Column, n_distinct: Column, n_rows: Column, threshold: float = 0.05) -> Column:
    """strings → classification; distinct/n < 0.05 → classification; else regression."""
    ratio = F.try_divide(n_distinct.cast("double"), n_rows.cast("double"))
    return F.when(is_string, "classification").when(ratio < threshold, "classification").otherwise("regression")


def label_index(df: DataFrame, column: str) -> DataFrame:
    """sorted distinct labels → 0..k−1 (the inverse is the same table read backwards)."""
    levels = df.where(qcol(column).isNotNull()).select(qcol(column).cast("string").alias("value")).distinct()
    return levels.select("value", (F.dense_rank().over(Window.orderBy("value")) - 1).cast("int").alias("index"))


def label_names(df: DataFrame, levels: list[str], prediction: str = "prediction", out: str = "predicted_label") -> DataFrame:
    """F11, inverse: the label that a class number stands for, from the sorted labels (null for other numbers)."""
    names = F.array(*[F.lit(v) for v in levels]).cast("array<string>")
    return df.withColumn(out, F.get(names, qcol(prediction).cast("int")))


# ------------------------------------------------------------------ distributed rank, folds, hold-out


def seeded_hash(key: Column, seed: int = 42) -> Column:
    """Pseudo-random but reproducible order key; md5 renders identically in SQL engines."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def rank_within(df: DataFrame, group: str, order: str, partitions: int | None = None) -> DataFrame:
    """Adds ``rank`` (0-based) of each row inside its ``group`` by ``order``, exactly, without
    putting a whole group into one task."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    p = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(p, qcol(group), qcol(order))
    local = (ranged.withColumn("_pid", F.spark_partition_id())
             .withColumn("_lr", F.row_number().over(Window.partitionBy("_pid", group).orderBy(order)) - 1)
             .checkpoint())
    counts = local.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), [group, "_pid"])
            .select(*df.columns, (F.col("_off") + F.col("_lr")).cast("long").alias("rank")))


def n_splits_for(counts: dict, problem: str, n_splits: int = 5, n_rows: int | None = None) -> int:
    """Stratified → max(2, min(5, rarest class)); otherwise max(2, min(5, n))."""
    if problem == "classification":
        rare = min(counts.values()) if counts else 0
        return max(2, min(n_splits, int(rare))) if rare else 2
    return max(2, min(n_splits, int(n_rows or 0)))


def assign_folds(df: DataFrame, key: str, label: str | None, k: int, seed: int = 42) -> DataFrame:
    """fold = rank mod k inside each class (stratified) or over all rows, in md5 order,
    so per-class fold sizes differ by at most one."""
    g = label if label is not None else "_all"
    base = df.withColumn("_all", F.lit(0)) if label is None else df
    ranked = rank_within(base.withColumn("_h", seeded_hash(qcol(key), seed)), g, "_h")
    out = ranked.withColumn("fold", (F.col("rank") % F.lit(k)).cast("int")).drop("_h", "rank")
    return out.drop("_all") if label is None else out


def holdout(df: DataFrame, key: str, label: str | None, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """M15 split: ``is_test`` for ceil(test_size·n) rows; stratified by class when every class
    has ≥ 2 rows (per-class floor, remainder to the largest fractional parts, ties by class)."""
    n = df.count()
    n_test = int(math.ceil(test_size * n))
    g = label if label is not None else "_all"
    base = df.withColumn("_all", F.lit(0)) if label is None else df
    counts = {r[0]: r[1] for r in base.groupBy(g).count().collect()}
    if label is not None and min(counts.values()) >= 2:
        alloc = {c: int(math.floor(test_size * m)) for c, m in counts.items()}
        rest = n_test - sum(alloc.values())
        frac = sorted(counts, key=lambda c: (-(test_size * counts[c] - alloc[c]), str(c)))
        for c in frac[:max(0, rest)]:
            alloc[c] += 1
    else:
        g = "_all"
        base = df.withColumn("_all", F.lit(0))
        alloc = {0: n_test}
    quota = F.create_map(*[x for c, a in alloc.items() for x in (F.lit(c), F.lit(a))])
    ranked = rank_within(base.withColumn("_h", seeded_hash(qcol(key), seed)), g, "_h")
    out = ranked.withColumn("is_test", F.col("rank") < F.element_at(quota, F.col(g))).drop("_h", "rank")
    return out.drop("_all") if "_all" in out.columns else out
