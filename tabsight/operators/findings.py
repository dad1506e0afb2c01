"""Rule-based findings as table operators.

A finding set is a list of *groups*; a group is an if/elif chain of rules, and each rule is
(condition, category, severity, message template). Applied to a metrics frame with one row
per subject (a dataset, a segment, a model, a clustering), every group contributes at most one
finding per subject, so profiling thousands of segments is one projection + ``inline``.

Conditions and template arguments are SQL expressions over the metrics columns: Spark
evaluates them with ``F.expr`` inside the projection (JVM-side), and the same rule table
renders the SQL used by the DuckDB oracle. Numbers in messages are rendered the same way on
both engines: ``round`` then cast to text; thousands separators for counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- rule model

Rule = tuple  # (condition_sql | None, category, severity, template, {placeholder: (kind, expr_sql)})

_PH = re.compile(r"\{(\w+)\}")


def _fmt_col(kind: str, expr: str) -> Column:
    x = F.expr(expr)
    if kind == "int":
        return x.cast("long").cast("string")
    if kind == "intc":
        return F.format_number(x.cast("long"), 0)
    if kind == "r0":
        return F.round(x.cast("double"), 0).cast("long").cast("string")
    if kind == "f1":
        return F.round(x.cast("double"), 1).cast("string")
    if kind == "f3":  # three decimals, also when they are zeros
        return F.format_string("%.3f", F.round(x.cast("double"), 3))
    if kind == "pct1":
        return F.concat(F.round(x.cast("double") * 100, 1).cast("string"), F.lit("%"))
    return x.cast("string")


def _fmt_sql(kind: str, expr: str) -> str:
    if kind == "int":
        return f"CAST(CAST({expr} AS BIGINT) AS VARCHAR)"
    if kind == "intc":
        return f"format('{{:,}}', CAST({expr} AS BIGINT))"
    if kind == "r0":
        return f"CAST(CAST(round(CAST({expr} AS DOUBLE), 0) AS BIGINT) AS VARCHAR)"
    if kind == "f1":
        return f"CAST(round(CAST({expr} AS DOUBLE), 1) AS VARCHAR)"
    if kind == "f3":
        return f"format('{{:.3f}}', round(CAST({expr} AS DOUBLE), 3))"
    if kind == "pct1":
        return f"CAST(round(CAST({expr} AS DOUBLE) * 100, 1) AS VARCHAR) || '%'"
    return f"CAST({expr} AS VARCHAR)"


def _render_col(template: str, args: dict) -> Column:
    parts, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        kind, expr = args[m.group(1)]
        parts.append(_fmt_col(kind, expr))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    if not parts:
        return F.lit("")
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _render_sql(template: str, args: dict) -> str:
    parts, pos = [], 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            parts.append(_sql_lit(template[pos:m.start()]))
        kind, expr = args[m.group(1)]
        parts.append(_fmt_sql(kind, expr))
        pos = m.end()
    if pos < len(template):
        parts.append(_sql_lit(template[pos:]))
    return " || ".join(parts) if parts else "''"


def _group_col(group: list) -> Column:
    out = None
    for cond, cat, sev, tmpl, args in group:
        val = F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"), _render_col(tmpl, args).alias("message"))
        c = F.expr(cond) if cond else F.lit(True)
        out = F.when(c, val) if out is None else out.when(c, val)
    return out


def _group_sql(group: list, field: str) -> str:
    whens = []
    for cond, cat, sev, tmpl, args in group:
        val = {"category": _sql_lit(cat), "severity": _sql_lit(sev), "message": _render_sql(tmpl, args)}[field]
        whens.append(f"WHEN {cond or 'true'} THEN {val}")
    return "CASE " + " ".join(whens) + " END"


def apply_findings(metrics: DataFrame, subject: str, groups: list, section: str) -> DataFrame:
    """(subject, section, rule, category, severity, message) — one row per subject and firing group."""
    items = [F.struct(F.lit(i).alias("rule"), _group_col(g).alias("f")) for i, g in enumerate(groups)]
    return (metrics.select(F.col(subject).cast("string").alias("subject"), F.inline(F.array(*items)))
            .where(F.col("f").isNotNull())
            .select("subject", F.lit(section).alias("section"), F.col("rule").cast("int").alias("rule"),
                    F.col("f.category").alias("category"), F.col("f.severity").alias("severity"),
                    F.col("f.message").alias("message")))


def findings_sql(metrics_sql: str, subject: str, groups: list, section: str) -> str:
    parts = []
    for i, g in enumerate(groups):
        parts.append(
            f"SELECT CAST({subject} AS VARCHAR) AS subject, {_sql_lit(section)} AS section, CAST({i} AS INTEGER) AS rule, "
            f"{_group_sql(g, 'category')} AS category, {_group_sql(g, 'severity')} AS severity, "
            f"{_group_sql(g, 'message')} AS message FROM ({metrics_sql}) m")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE message IS NOT NULL"


# --------------------------------------------------------------------------- rule sets
# The finding texts and thresholds below are the product's outputs and cuts.

# G1 data quality — metrics: n_records, missing_pct (0–100), n_features
DATA_QUALITY = [
    [("n_records < 100", "records", "warning", "⚠️ **Small Dataset**: Only {n} records. Consider collecting more data for reliable patterns.", {"n": ("int", "n_records")}),
     ("n_records < 1000", "records", "info", "📊 **Adequate Sample Size**: {n} records provide good statistical foundation.", {"n": ("intc", "n_records")}),
     (None, "records", "success", "✅ **Robust Dataset**: {n} records enable reliable analysis and modeling.", {"n": ("intc", "n_records")})],
    [("missing_pct > 30", "missing", "warning", "⚠️ **High Missing Data**: {m}% of data is missing. Data quality issues may impact model reliability.", {"m": ("f1", "missing_pct")}),
     ("missing_pct > 10", "missing", "warning", "⚠️ **Moderate Missing Data**: {m}% missing. Review collection processes.", {"m": ("f1", "missing_pct")}),
     ("missing_pct > 0", "missing", "success", "✅ **Good Data Completeness**: Only {m}% missing values.", {"m": ("f1", "missing_pct")}),
     (None, "missing", "success", "✅ **Perfect Data**: No missing values detected.", {})],
    [("n_features < 3", "features", "warning", "⚠️ **Limited Features**: Only {f} features. Consider feature engineering.", {"f": ("int", "n_features")}),
     ("n_features < 10", "features", "success", "✅ **Focused Feature Set**: {f} features provide clear analysis scope.", {"f": ("int", "n_features")}),
     (None, "features", "info", "📊 **Rich Data**: {f} features enable comprehensive analysis.", {"f": ("int", "n_features")})],
]

# G14 missing-data flag — metrics: missing_pct
MISSING_FLAG = [
    [("missing_pct < 10", "missing", "success", "Healthy", {}),
     (None, "missing", "warning", "Needs review", {})],
]

# G2 clustering (business) — metrics: n_clusters, silhouette, min_size, max_size, n_noise, n_rows
_SIL = "coalesce(silhouette, -1.0)"
CLUSTERING_BUSINESS = [
    [(f"{_SIL} > 0.5", "quality", "success", "🎯 **Cluster Quality**: **Strong** ({s}). Segments are reasonably distinct and likely usable.", {"s": ("f3", _SIL)}),
     (f"{_SIL} > 0.2", "quality", "info", "🎯 **Cluster Quality**: **Moderate** ({s}). Segments exist, but overlap suggests cautious interpretation.", {"s": ("f3", _SIL)}),
     (f"{_SIL} > 0", "quality", "warning", "🎯 **Cluster Quality**: **Weak** ({s}). Segments are loose and should not be treated as strong business groups yet.", {"s": ("f3", _SIL)}),
     (None, "quality", "warning", "🎯 **Cluster Quality**: **Weak** ({s}). No reliable segmentation signal detected. Revisit features or clustering settings.", {"s": ("f3", _SIL)})],
    [("n_clusters <= 1", "segments", "warning", "⚠️ **Homogeneous Data**: Only 1 cluster found. Dataset may lack natural groupings.", {}),
     ("n_clusters <= 3", "segments", "success", "🎯 **Clear Segmentation**: Data naturally groups into **{k}** distinct segments. Large actionable groups.", {"k": ("int", "n_clusters")}),
     ("n_clusters <= 5", "segments", "info", "📊 **Moderate Complexity**: **{k}** clusters indicate diverse patterns. Requires targeted strategies per segment.", {"k": ("int", "n_clusters")}),
     ("n_clusters <= 10", "segments", "info", "🔍 **High Granularity**: **{k}** clusters. Detailed segmentation enables specialized targeting.", {"k": ("int", "n_clusters")}),
     (None, "segments", "info", "🔬 **Fine-Grained**: **{k}** clusters. Consider consolidation for operational simplicity.", {"k": ("int", "n_clusters")})],
    [("min_size IS NULL", "balance", "info", "", {}),
     ("(CASE WHEN min_size > 0 THEN max_size / min_size ELSE 0 END) > 10", "balance", "warning",
      "⚠️ **Unbalanced Segments**: Largest cluster is {r}x larger than smallest. Some segments may be underserved.",
      {"r": ("r0", "CASE WHEN min_size > 0 THEN CAST(max_size AS DOUBLE) / min_size ELSE 0 END")}),
     ("(CASE WHEN min_size > 0 THEN max_size / min_size ELSE 0 END) > 3", "balance", "info",
      "📊 **Varied Segment Sizes**: Clusters range from {lo} to {hi} samples. Tailor strategies per size.", {"lo": ("int", "min_size"), "hi": ("int", "max_size")}),
     (None, "balance", "success", "✅ **Balanced Segments**: Clusters are evenly distributed, enabling consistent strategies.", {})],
    [("n_noise > 0 AND n_noise * 100.0 / n_rows > 20", "noise", "warning", "⚠️ **High Outlier Count**: {p}% of data are outliers. Investigate anomalies.", {"p": ("f1", "n_noise * 100.0 / n_rows")}),
     ("n_noise > 0 AND n_noise * 100.0 / n_rows > 5", "noise", "info", "📌 **Outliers Present**: {p}% outliers detected. Review for anomalies or special cases.", {"p": ("f1", "n_noise * 100.0 / n_rows")})],
]

# G3 clustering (analyst) — metrics: silhouette, n_clusters, n_noise, n_rows
CLUSTER_QUALITY = [
    [(f"{_SIL} > 0.5", "quality", "success", "Clustering quality is **strong** ({s} silhouette score): clusters are reasonably well-separated.", {"s": ("f3", _SIL)}),
     (f"{_SIL} > 0.2", "quality", "info", "Clustering quality is **moderate** ({s} silhouette score): clusters show some structure, but overlap is still meaningful.", {"s": ("f3", _SIL)}),
     (f"{_SIL} > 0", "quality", "warning", "Clustering quality is **weak** ({s} silhouette score): clusters are loose and should be interpreted cautiously.", {"s": ("f3", _SIL)}),
     (None, "quality", "warning", "Clustering quality is **weak** ({s} silhouette score): clusters are not well-defined.", {"s": ("f3", _SIL)})],
    [("n_clusters <= 1", "segments", "warning", "⚠️ Warning: Only 1 cluster was identified. The data may be too homogeneous for meaningful segmentation.", {}),
     ("n_clusters <= 3", "segments", "success", "Data naturally groups into **{k} distinct segments**. This level of segmentation suggests clear patterns in the dataset.", {"k": ("int", "n_clusters")}),
     ("n_clusters <= 10", "segments", "info", "Data forms **{k} clusters**. This suggests moderate complexity with multiple but identifiable patterns.", {"k": ("int", "n_clusters")}),
     (None, "segments", "info", "Data fragments into **{k} clusters**. This may indicate high diversity or need for dimensionality reduction.", {"k": ("int", "n_clusters")})],
    [("n_noise > 0 AND n_noise * 1.0 / n_rows > 0.2", "noise", "warning", "⚠️ High noise level ({p} points unassigned). This suggests some anomalous or transitional data points.", {"p": ("pct1", "n_noise * 1.0 / n_rows")}),
     ("n_noise > 0 AND n_noise * 1.0 / n_rows > 0.05", "noise", "info", "{p} of data points are outliers/noise points. These represent boundary cases between clusters.", {"p": ("pct1", "n_noise * 1.0 / n_rows")})],
]

# G4 cluster-size balance — metrics: all_min_size, all_max_size, avg_size (noise label included)
CLUSTER_BALANCE = [
    [("all_max_size * 1.0 / all_min_size > 10", "balance", "warning",
      "Cluster sizes vary significantly (largest: {hi}, smallest: {lo}). Some segments are much more populous than others.",
      {"hi": ("int", "all_max_size"), "lo": ("int", "all_min_size")}),
     (None, "balance", "success", "Clusters are relatively balanced (avg: {a} samples). Suggests stable, well-distributed patterns.", {"a": ("r0", "avg_size")})],
]

# G5 model (business) — metrics: problem_type, best_score, cv_mean, cv_std
_CV = "CASE WHEN cv_mean > 0 THEN cv_std / cv_mean ELSE 0 END"
MODEL_BUSINESS = [
    [("problem_type = 'classification' AND best_score > 0.75", "performance", "success",
      "📈 **Model Performance**: **Strong** (>75%) accuracy ({p}). Predictions have meaningful signal. ✅ Suitable for guided decision support with monitoring.", {"p": ("pct1", "best_score")}),
     ("problem_type = 'classification' AND best_score >= 0.60", "performance", "info",
      "📈 **Model Performance**: **Moderate** (60%-75%) accuracy ({p}). Predictions may help, but uncertainty remains material. ⚠️ Use with human review and keep improving features/data.", {"p": ("pct1", "best_score")}),
     ("problem_type = 'classification'", "performance", "warning",
      "📈 **Model Performance**: **Weak** (<60%) accuracy ({p}). Predictions are unreliable. 🔴 Not production-ready. Improve preprocessing, features, or data quality first.", {"p": ("pct1", "best_score")}),
     ("best_score > 0.75", "performance", "success",
      "📊 **Model Performance**: **Strong** (>0.75 R²) (R² = {s}). Model captures most of the target variation. ✅ Reasonable candidate for monitored production use.", {"s": ("f3", "best_score")}),
     ("best_score >= 0.60", "performance", "info",
      "📊 **Model Performance**: **Moderate** (0.60-0.75 R²) (R² = {s}). Model captures some useful signal. ⚠️ Use for guidance and continue iterating.", {"s": ("f3", "best_score")}),
     (None, "performance", "warning",
      "📊 **Model Performance**: **Weak** (<0.60 R²) (R² = {s}). Predictive power is limited. 🔴 Not production-ready. Requires better features or more data.", {"s": ("f3", "best_score")})],
    [("cv_mean IS NULL", "stability", "info", "", {}),
     (f"{_CV} < 0.05", "stability", "success", "✅ **Stable Model**: Consistent performance across folds (±{s}). Safe for deployment.", {"s": ("f3", "cv_std")}),
     (f"{_CV} < 0.10", "stability", "info", "📊 **Reasonable Stability**: Small variance across folds (±{s}). Generally stable.", {"s": ("f3", "cv_std")}),
     (None, "stability", "warning", "⚠️ **High Variance**: Performance varies significantly (±{s}). Monitor in production.", {"s": ("f3", "cv_std")})],
]

# G6 performance (analyst) — metrics: problem_type, best_score, model_name
PERFORMANCE = [
    [("problem_type = 'classification' AND best_score > 0.75", "performance", "success",
      "Model **{m}** demonstrates **strong** performance ({p} accuracy). The model has meaningful predictive signal and can support decisions with monitoring.",
      {"m": ("str", "model_name"), "p": ("pct1", "best_score")}),
     ("problem_type = 'classification' AND best_score >= 0.60", "performance", "info",
      "Model **{m}** demonstrates **moderate** performance ({p} accuracy). The model captures some useful patterns, but predictions still need caution.",
      {"m": ("str", "model_name"), "p": ("pct1", "best_score")}),
     ("problem_type = 'classification'", "performance", "warning",
      "Model **{m}** demonstrates **weak** performance ({p} accuracy). Model performance is weak. Predictions are unreliable..",
      {"m": ("str", "model_name"), "p": ("pct1", "best_score")}),
     ("best_score > 0.75", "performance", "success",
      "Model **{m}** shows **strong** predictive power (R²={s}), which explains most of the variance in the target.",
      {"m": ("str", "model_name"), "s": ("f3", "best_score")}),
     ("best_score >= 0.60", "performance", "info",
      "Model **{m}** shows **moderate** predictive power (R²={s}), which captures some of the target variance, but errors remain material.",
      {"m": ("str", "model_name"), "s": ("f3", "best_score")}),
     (None, "performance", "warning",
      "Model **{m}** shows **weak** predictive power (R²={s}), which captures too little target variance for reliable use.",
      {"m": ("str", "model_name"), "s": ("f3", "best_score")})],
]

# G9 optimisation hints — metrics: best_score, top_feature
OPTIMIZATION = [
    [("best_score < 0.6", "optimization", "info",
      "💡 **Optimization Opportunity**: Performance is currently weak. Improve feature quality, revisit preprocessing, or collect more representative data.", {})],
    [("top_feature IS NOT NULL", "focus", "info",
      "**Focus Area**: Improving **{f}** quality/measurement could directly enhance model performance, as it's the strongest predictor.", {"f": ("str", "top_feature")})],
]

# G10 recommendations (business) — metrics: problem_type, best_score, n_records, missing_pct, top_feature
NEXT_STEPS = [
    [("problem_type = 'classification' AND best_score < 0.60", "model", "info",
      "📝 **Improve Model Accuracy**: Collect more data, engineer new features, or try ensemble methods.", {}),
     ("problem_type = 'regression' AND best_score < 0.60", "model", "info",
      "📝 **Enhance Predictions**: Focus on feature quality and domain-specific engineering.", {})],
    [("n_records < 1000", "data", "info",
      "📊 **Expand Dataset**: Current size limits pattern detection. Aim for 5,000+ samples for robust insights.", {})],
    [("missing_pct > 10", "data", "info", "🔍 **Review Data Collection**: High missing rate suggests gaps in collection process.", {})],
    [("top_feature IS NOT NULL", "features", "info",
      "💡 **Focus on {f}**: This is your strongest predictor. Invest in improving its quality/measurement.", {"f": ("str", "top_feature")})],
    [("best_score > 0.75", "monitoring", "success",
      "✅ **Set up Monitoring**: Track model performance in production. Retrain monthly or on data drift.", {}),
     (None, "monitoring", "warning",
      "⚠️ **Plan for Iteration**: Expect model updates as you collect more data. Don't rely solely on current model.", {})],
]

# G11 recommendations (analyst) — metrics: missing_pct, n_records, n_features, has_clustering
RECOMMEND = [
    [("missing_pct > 20", "data", "warning",
      "**Data Quality**: High missing value ratio. Consider collecting more complete data or investigate missing patterns.", {})],
    [("n_records < 100", "data", "warning",
      "**Sample Size**: Dataset is small. Collect more data to improve model robustness and generalization.", {})],
    [("n_features < 3", "features", "warning",
      "**Feature Engineering**: Limited feature set. Engineer new features from existing data to improve model performance.", {})],
    [("has_clustering", "clustering", "info", "**Use Case**: Leverage cluster assignments for targeted strategies per segment.", {})],
    [("NOT (missing_pct > 20) AND NOT (n_records < 100) AND NOT (n_features < 3) AND NOT has_clustering", "general", "success",
      "✅ **Good Data Quality**: Dataset appears well-structured. Consider iterating on feature engineering for further improvements.", {})],
]

# G7 feature drivers (business) — metrics: n_imp, f1, f2, f3, p1, p2, p3 (shares, %), top5_pct
FEATURES_BUSINESS = [
    [("n_imp = 0", "drivers", "info", "📊 **Feature Analysis**: Model does not support feature importance extraction.", {}),
     ("n_imp = 1", "drivers", "info", "🎯 **Primary Driver**: **{a}** is the dominant predictor ({pa}% importance). Focus optimization here.",
      {"a": ("str", "f1"), "pa": ("r0", "p1")}),
     ("n_imp = 2", "drivers", "info", "🎯 **Key Drivers**: **{a}** and **{b}** drive predictions ({pa}% + {pb}%).",
      {"a": ("str", "f1"), "b": ("str", "f2"), "pa": ("r0", "p1"), "pb": ("r0", "p2")}),
     (None, "drivers", "info", "🎯 **Top Drivers**: **{a}**, **{b}**, and **{c}** account for {pt}% of model influence.",
      {"a": ("str", "f1"), "b": ("str", "f2"), "c": ("str", "f3"), "pt": ("r0", "p1 + p2 + p3")})],
    [("n_imp = 0", "concentration", "info", "", {}),
     ("top5_pct > 80", "concentration", "info", "🔍 **Concentrated Dependencies**: Top 5 features drive {p}% of predictions. Few key factors matter.", {"p": ("r0", "top5_pct")}),
     ("top5_pct > 60", "concentration", "info", "📊 **Moderate Dependencies**: Distributed influence across multiple features.", {}),
     (None, "concentration", "info", "📈 **Diverse Model**: Many features contribute meaningfully. Robust to individual feature changes.", {})],
]

# G8 feature drivers (analyst) — metrics: n_imp, f1, f2, f3, n_positive, n_total
DRIVERS = [
    [("n_imp = 0", "drivers", "info", "Feature importance could not be computed for this model.", {}),
     ("n_imp = 1", "drivers", "info", "**Top predictive drivers**: **{a}**. These features are the strongest indicators for model predictions.", {"a": ("str", "f1")}),
     ("n_imp = 2", "drivers", "info", "**Top predictive drivers**: **{a}**, **{b}**. These features are the strongest indicators for model predictions.",
      {"a": ("str", "f1"), "b": ("str", "f2")}),
     (None, "drivers", "info", "**Top predictive drivers**: **{a}**, **{b}**, and **{c}**. These features are the strongest indicators for model predictions.",
      {"a": ("str", "f1"), "b": ("str", "f2"), "c": ("str", "f3")})],
    [("n_imp = 0", "breadth", "info", "", {}),
     ("n_positive < n_total * 0.2", "breadth", "info",
      "Only {i}/{t} features are significantly influential. The model relies on a concentrated set of predictors.", {"i": ("int", "n_positive"), "t": ("int", "n_total")}),
     (None, "breadth", "info", "{i}/{t} features contribute meaningfully to predictions. The model considers diverse information sources.",
      {"i": ("int", "n_positive"), "t": ("int", "n_total")})],
]


def _drop_empty(df: DataFrame) -> DataFrame:
    return df.where(F.col("message") != "")


def run(metrics: DataFrame, subject: str, groups: list, section: str) -> DataFrame:
    return _drop_empty(apply_findings(metrics, subject, groups, section))


def run_sql(metrics_sql: str, subject: str, groups: list, section: str) -> str:
    return f"SELECT * FROM ({findings_sql(metrics_sql, subject, groups, section)}) WHERE message <> ''"


# --------------------------------------------------------------------------- importance summaries


def importance_summary(imp: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """One row: n_imp (top-3 size), f1..f3, p1..p3 (% of total), top5_pct, n_positive, n_total.

    Ranks come from a window over the importance table, whose size is the number of features."""
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("imp"), F.asc("feature"))
    r = imp.select(F.col(feature).alias("feature"), F.col(importance).cast("double").alias("imp")).withColumn("rk", F.row_number().over(w))
    tot = F.sum("imp")

    def top(i):
        return F.max(F.when(F.col("rk") == i, F.col("feature")))

    def share(i):
        return F.coalesce(F.try_divide(F.sum(F.when(F.col("rk") == i, F.col("imp"))) * 100.0, tot), F.lit(0.0))

    return r.agg(F.least(F.count(F.lit(1)), F.lit(3)).cast("int").alias("n_imp"),
                 top(1).alias("f1"), top(2).alias("f2"), top(3).alias("f3"),
                 share(1).alias("p1"), share(2).alias("p2"), share(3).alias("p3"),
                 F.coalesce(F.try_divide(F.sum(F.when(F.col("rk") <= 5, F.col("imp"))) * 100.0, tot), F.lit(0.0)).alias("top5_pct"),
                 F.count_if(F.col("imp") > 0).cast("long").alias("n_positive"), F.count(F.lit(1)).cast("long").alias("n_total"))
