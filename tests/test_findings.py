"""Findings rules at, just under and just over their cuts (inline metric tables)."""

from tabsight.operators import findings as FD


def _msgs(spark, rows, schema, groups):
    df = spark.createDataFrame(rows, schema)
    out = FD.run(df, "subject", groups, "t").collect()
    return {(r.subject, r.rule): r.message for r in out}


def test_data_quality_cuts(spark):
    rows = [("a", 99, 0.0, 2), ("b", 100, 10.0, 3), ("c", 999, 10.05, 9), ("d", 1000, 30.0, 10), ("e", 1234, 30.01, 12)]
    m = _msgs(spark, rows, "subject string, n_records long, missing_pct double, n_features int", FD.DATA_QUALITY)
    assert m[("a", 0)].startswith("⚠️ **Small Dataset**: Only 99 records")
    assert m[("b", 0)].startswith("📊 **Adequate Sample Size**: 100 records")
    assert m[("e", 0)].startswith("✅ **Robust Dataset**: 1,234 records")
    assert m[("a", 1)] == "✅ **Perfect Data**: No missing values detected."
    assert m[("b", 1)].startswith("✅ **Good Data Completeness**: Only 10.0%")
    assert m[("c", 1)].startswith("⚠️ **Moderate Missing Data**: 10.1% missing")
    assert m[("e", 1)].startswith("⚠️ **High Missing Data**: 30.0% of data")
    assert m[("a", 2)].startswith("⚠️ **Limited Features**: Only 2 features")
    assert m[("b", 2)].startswith("✅ **Focused Feature Set**: 3 features")
    assert m[("d", 2)].startswith("📊 **Rich Data**: 10 features")


def test_model_performance_cuts(spark):
    rows = [("w", "classification", 0.5999, 0.5999, 0.0), ("m", "classification", 0.60, 0.60, 0.0301),
            ("m2", "classification", 0.75, 0.75, 0.06), ("s", "classification", 0.7501, 0.7501, 0.2),
            ("r", "regression", 0.8, 0.8, None)]
    m = _msgs(spark, rows, "subject string, problem_type string, best_score double, cv_mean double, cv_std double",
              FD.MODEL_BUSINESS)
    assert "**Weak** (<60%)" in m[("w", 0)] and "**Moderate** (60%-75%)" in m[("m", 0)]
    assert "**Moderate** (60%-75%)" in m[("m2", 0)] and "**Strong** (>75%)" in m[("s", 0)]
    assert "(R² = 0.800)" in m[("r", 0)]
    assert m[("w", 1)].startswith("✅ **Stable Model**")          # cv 0 < 0.05
    assert m[("m", 1)].startswith("📊 **Reasonable Stability**")   # cv 0.0502
    assert m[("m2", 1)].startswith("📊 **Reasonable Stability**")  # cv 0.08 < 0.10
    assert m[("s", 1)].startswith("⚠️ **High Variance**")


def test_clustering_cuts(spark):
    rows = [("one", 1, 0.6, 10, 10, 0, 100), ("three", 3, 0.5, 10, 101, 0, 121), ("five", 5, 0.2001, 10, 31, 6, 100),
            ("ten", 10, 0.0, 10, 30, 21, 100), ("many", 11, None, None, None, 0, 100)]
    m = _msgs(spark, rows, "subject string, n_clusters long, silhouette double, min_size long, max_size long, "
                           "n_noise long, n_rows long", FD.CLUSTERING_BUSINESS)
    assert "**Strong** (0.600)" in m[("one", 0)] and "**Moderate** (0.500)" in m[("three", 0)]
    assert "No reliable segmentation" in m[("ten", 0)] and "(-1.000)" in m[("many", 0)]
    assert m[("one", 1)].startswith("⚠️ **Homogeneous Data**")
    assert "**3** distinct segments" in m[("three", 1)] and "**5** clusters indicate" in m[("five", 1)]
    assert m[("ten", 1)].startswith("🔍 **High Granularity**") and m[("many", 1)].startswith("🔬 **Fine-Grained**")
    assert m[("three", 2)].startswith("⚠️ **Unbalanced Segments**: Largest cluster is 10x larger")  # 101/10
    assert m[("five", 2)].startswith("📊 **Varied Segment Sizes**: Clusters range from 10 to 31")
    assert ("one", 2) in m and m[("one", 2)].startswith("✅ **Balanced Segments**")
    assert ("many", 2) not in m                                     # no sizes → no balance finding
    assert m[("five", 3)].startswith("📌 **Outliers Present**: 6.0%")
    assert m[("ten", 3)].startswith("⚠️ **High Outlier Count**: 21.0%")


def test_recommendation_fallback(spark):
    rows = [("ok", 5000, 1.0, 12, False), ("small", 50, 25.0, 2, True)]
    m = _msgs(spark, rows, "subject string, n_records long, missing_pct double, n_features int, has_clustering boolean",
              FD.RECOMMEND)
    assert m[("ok", 4)].startswith("✅ **Good Data Quality**") and ("ok", 0) not in m
    assert ("small", 4) not in m and m[("small", 0)].startswith("**Data Quality**")
    assert m[("small", 1)].startswith("**Sample Size**") and m[("small", 2)].startswith("**Feature Engineering**")
    assert m[("small", 3)].startswith("**Use Case**")
