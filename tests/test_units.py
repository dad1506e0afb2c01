"""Edge cases on small inline tables (FIXTURES §4) and threshold tests for the rule bands."""

import math

import pytest
from pyspark.sql import functions as F

from tabsight.functions import bands as BD
from tabsight.functions import names as N
from tabsight.functions.classes import classify
from tabsight.operators import findings as FD
from tabsight.operators import model_eval as ME
from tabsight.operators import prep as PR
from tabsight.operators import profile as P
from tabsight.operators import screen as S
from tabsight.operators import stats as ST
from tabsight.operators.quantiles import exact_quantiles
from tabsight.sources import csv as CSV


def test_constant_table_moments(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 3.0), (4.0, 5.0, 9.0), (9.0, 5.0, 1.0)], "x double, c double, z double")
    fd = {r.column_name: r for r in ST.feature_distribution(df).collect()}
    assert fd["x"].skewness == pytest.approx(0.768417, abs=1e-6)
    assert fd["x"].kurtosis == pytest.approx(-1.0, abs=1e-6)
    assert fd["x"].std == pytest.approx(3.559026, abs=1e-6)
    assert fd["c"].skewness is None  # constant column → NULL, not NaN or an error
    corr = {(r.x, r.y): r.r for r in ST.correlation_matrix(df).collect()}
    assert corr[("x", "c")] is None
    assert corr[("x", "z")] == pytest.approx(-0.466321, abs=1e-6)
    q = exact_quantiles(df, ["x"], [0.25])
    assert q["x"][0] == pytest.approx(1.75)
    prof = {r.column_name: r for r in P.column_profile(df).collect()}
    assert prof["x"].std_pop == pytest.approx(3.082207, abs=1e-6)


def test_even_median_and_all_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "a double")
    assert exact_quantiles(df, ["a"], [0.5])["a"][0] == 2.5
    pre = PR.Preprocessor().fit(df)
    assert pre.num_fill["a"] == 2.5
    df2 = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    pre2 = PR.Preprocessor().fit(df2)
    assert pre2.numeric_features == ["a"]  # all-NULL column dropped


def test_quantiles_equal_percentile(spark):
    df = spark.range(0, 20011).select(((F.col("id") * 7919) % 10007 / 3.0).alias("v"))
    probs = [0.1, 0.25, 0.5, 0.9]
    direct = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs]))).first()[0]
    for a, b in zip(direct, exact_quantiles(df, ["v"], probs)["v"], strict=True):
        assert a == pytest.approx(b, rel=1e-12)


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "a double, b string")
    scr = {r.column_name: r.reason for r in S.screen_columns(empty).collect()}
    assert scr["a"] == N.REASON_CONSTANT and scr["b"] == N.REASON_CONSTANT
    one = spark.createDataFrame([(1.0,)], "a double")
    # 1 distinct of 1 row is a ratio of 1.0 > 0.95: the cardinality rule fires before near-constant
    assert S.screen_columns(one).first().reason == "High cardinality (1 unique values, likely ID)"
    fd = ST.feature_distribution(one).first()
    assert fd.error == "Insufficient data"


def test_nan_inf_and_mixed_types(spark):
    from tabsight.functions.safe import normalize_missing
    df = normalize_missing(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "a double"))
    assert df.where(F.col("a").isNull()).count() == 1
    mixed = spark.sql("SELECT 1 AS i, CAST(1.5 AS DECIMAL(10,2)) AS d, 2.0D AS f, 's' AS s, true AS t, "
                      "DATE'2020-01-01' AS dt, array(1) AS arr")
    assert dict(classify(mixed)) == {"i": "numeric", "d": "numeric", "f": "numeric", "s": "categorical",
                                     "t": "boolean", "dt": "datetime", "arr": "other"}


def test_unseen_level_and_blank(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    pre = PR.Preprocessor().fit(fit)
    assert pre.feature_names() == ["c_a", "c_b"]
    new = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    got = [tuple(r) for r in pre.transform(new).collect()]
    # NULL is imputed with the mode ("b"); an unseen level encodes as all zeros
    assert got == [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]
    blank = spark.createDataFrame([("  ",), ("x",), ("",)], "c string")
    assert PR.blank_to_null(blank).where(F.col("c").isNull()).count() == 2


def test_name_rules():
    assert N.is_id_like_name("width")      # substring rule, as in the reference
    assert N.is_date_name("created_at") and N.is_text_name("Product Name")
    assert N.is_prep_id_name("user_id") and N.is_prep_id_name("id") and not N.is_prep_id_name("width")
    assert N.model_filename("Sale Price", "Random Forest") == "sale_price_random_forest_model.pkl"
    assert len(N.model_filename("x" * 300, "m")) == 204


def test_band_thresholds(spark):
    df = spark.createDataFrame([(0.5999,), (0.60,), (0.75,), (0.7501,)], "score double")
    got = [r[0] for r in df.select(BD.performance_band("score")).collect()]
    assert got == ["weak", "moderate", "moderate", "strong"]
    sil = spark.createDataFrame([(v,) for v in [-0.2001, -0.2, 0.0, 0.2, 0.2001, 0.3, 0.5, 0.5001, 0.7]], "s double")
    q = [r[0] for r in sil.select(BD.cluster_quality_band("s")).collect()]
    assert q == ["weak", "weak", "weak", "weak", "moderate", "moderate", "moderate", "strong", "strong"]
    msg, level = BD.silhouette_reading(F.col("s"))
    lv = [r[0] for r in sil.select(level).collect()]
    assert lv == ["error", "warning", "warning", "warning", "warning", "info", "success", "success", "success"]


def test_adjusted_score(spark):
    df = spark.createDataFrame([(0.4, 1, 0, 100), (0.4, 3, 50, 100), (0.4, 3, 30, 100)], "s double, k int, nn long, n long")
    got = [round(r[0], 6) for r in df.select(BD.adjusted_cluster_score("s", "k", "nn", "n")).collect()]
    assert got == [-0.6, 0.0, 0.4]


def test_fold_stability_and_importance_zero(spark):
    scores = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.0), ("b", 1, 0.0)], "model string, fold int, score double")
    st = {r.model: r for r in ME.fold_stability(scores).collect()}
    assert st["a"].cv == pytest.approx(0.1 / 0.6, abs=1e-6) and st["b"].cv == 0.0
    imp = spark.createDataFrame([("f1", 0.0), ("f2", 0.0)], "feature string, importance double")
    s = FD.importance_summary(imp).first()
    assert s.p1 == 0.0 and s.n_positive == 0  # all-zero importances: no division error


def test_regression_metrics_constant_truth(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert ME.regression_metrics(df).first().r2 == 1.0
    df2 = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert ME.regression_metrics(df2).first().r2 == 0.0


def test_csv_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b,c,d,a\n1,NA,2020-01-01,True,x\n2,,2020-01-02,False,y\n3,2.5,2020-01-03,True,z \n")
    df = CSV.read_csv(spark, str(p))
    assert df.columns == ["a", "b", "c", "d", "a.1"]
    types = dict(df.dtypes)
    assert types["a"] == "bigint" and types["b"] == "double" and types["c"] == "string" and types["d"] == "boolean"
    assert df.where(F.col("b").isNull()).count() == 2
    assert CSV.dedupe_header(["a", "a", "a.1"]) == ["a", "a.1", "a.1.1"]


def test_two_blobs_histogram(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.0,), (10.5,)], "x double")
    h = ST.histogram(df, "x").collect()
    assert sum(r["count"] for r in h) == 4 and max(r.bin for r in h) == 30
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.bin for r in ST.histogram(same, "x").collect()] == [1]


def test_outlier_guards(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (100.0,)], "x double")
    assert ME is not None
    r = ST.outliers_iqr(df).first()
    assert r.n_outliers == 0 and r.outlier_ratio == 0.0  # fewer than 4 values
    assert math.isfinite(1.0)


def test_univariate_dispatch(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (2.0, "b")], "x double, c string")
    assert "bin" in ST.univariate(df, "x").columns
    assert [tuple(r) for r in ST.univariate(df, "c").collect()] == [("b", 2), ("a", 1)]


def test_pca_drops_all_null_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, None), (4.0, 3.0)], "a double, b double")
    out, ratios = PR.pca(df, ["a", "b"], 2, drop_all_null_rows=True)
    assert out.count() == 4 and abs(sum(ratios) - 1.0) < 1e-9


def test_csv_from_pythons_writer(spark, tmp_path):
    import csv

    from tabsight.sources.csv import read_csv
    rows = [["", "a", "a", "`odd`"], ["1", '{"k": "v, w"}', "two\nlines", "x"], ["2", 'say "hi"', "", "y"]]
    with open(tmp_path / "t.csv", "w", newline="") as f:
        csv.writer(f).writerows(rows)
    back = read_csv(spark, f"file://{tmp_path}/t.csv")
    assert back.columns == ["Unnamed: 0", "a", "a.1", "`odd`"]
    assert sorted(tuple(r) for r in back.collect()) == [
        (1, '{"k": "v, w"}', "two\nlines", "x"), (2, 'say "hi"', None, "y")]


def test_report_reads_the_cleaned_table(spark):
    from tabsight.plans.analysis import report_quality
    rows = [(float(i), None if i % 4 == 0 else "x") for i in range(100)]
    q = report_quality(spark.createDataFrame(rows, "v double, w string")).first()
    assert (q["n_records"], q["n_features"], q["n_numeric"], q["n_categorical"], q["missing_pct"]) == (100, 2, 1, 1, 12.5)


def test_kmeans_starts_reach_a_distant_cluster_of_few_rows(spark):
    import numpy as np
    from tabsight.operators.kmeans import kmeans

    rng = np.random.default_rng(8)
    far = [(100_000 + i, 500.0 + i, 500.0) for i in range(4)]  # one row in 25,000
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(100_000, 2)))] + far,
                                   "row_id long, x double, y double")
    labels, _, _, cost = kmeans(points, ["x", "y"], k=2, rescale=False)
    own = {r["cluster"]: r["count"] for r in labels.groupBy("cluster").count().collect()}
    assert sorted(own.values()) == [4, 100_000] and cost < 300_000


def test_kmeans_does_not_depend_on_the_partitioning(spark):
    from pyspark.sql import functions as F

    from tabsight.operators.kmeans import kmeans
    points = spark.range(400).select(F.col("id").alias("row_id"), (F.pmod("id", F.lit(4)) * 5 + F.rand(1)).alias("x"),
                                     (F.pmod("id", F.lit(4)) * 3 + F.rand(2)).alias("y"))
    points = spark.createDataFrame(points.collect(), points.schema)
    found = []
    for n in (1, 8, 60):
        labels, k, search, cost = kmeans(points.repartition(n), ["x", "y"], n_init=3, max_k=6)
        found.append((k, sorted((r["row_id"], r["cluster"]) for r in labels.collect()), round(cost, 9)))
        assert [s[0] for s in search] == list(range(2, 7))
    assert found[0] == found[1] == found[2] and found[0][0] == 4


def test_negative_zero_is_zero(spark):
    from tabsight.operators.profile import frequency_table
    values = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "v double")
    assert sorted((r["value"], r["cnt"]) for r in frequency_table(values).collect()) == [("0.0", 2), ("1.0", 1)]
