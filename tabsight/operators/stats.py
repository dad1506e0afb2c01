"""Descriptive statistics reports over numeric columns.

Moments come from one global aggregate per call (partial aggregation per task, a single
small final merge); exact quantiles from ``quantiles.exact_quantiles``; everything else is a
projection of those one-row results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import CATEGORICAL, NUMERIC, classify
from ..functions.safe import qcol
from .profile import column_profile, combine_scalars, distinct_counts, frequency_table, top_values
from .quantiles import exact_quantiles

R = 6


def _numeric_cols(df: DataFrame, columns: list[str] | None) -> list[str]:
    return list(columns) if columns is not None else [c for c, k in classify(df) if k == NUMERIC]


def _quantile_table(df: DataFrame, cols: list[str], probs: list[float], names: list[str]) -> DataFrame:
    """(column_name, q...) from exact quantiles; a table of #columns rows."""
    q = exact_quantiles(df, cols, probs)
    spark = df.sparkSession
    rows = [tuple([c] + [float(v) if v is not None else None for v in q[c]]) for c in cols]
    schema = "column_name string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A5: count, mean, std (ddof 1), min, 25/50/75 % (linear), max per numeric column."""
    cols = _numeric_cols(df, columns)
    prof = column_profile(df, cols)
    qt = _quantile_table(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return (prof.join(F.broadcast(qt), "column_name", "left").orderBy("position")
            .select("column_name", F.col("n_nonnull").cast("long").alias("count"),
                    F.round("mean", R).alias("mean"), F.round("std_samp", R).alias("std"),
                    F.round("min", R).alias("min"), F.round("q25", R).alias("q25"),
                    F.round("q50", R).alias("q50"), F.round("q75", R).alias("q75"),
                    F.round("max", R).alias("max")))


def feature_distribution(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, median, std, min, max, variance, skewness (population), excess kurtosis,
    missing ratio; fewer than 2 non-null values → an 'Insufficient data' error row."""
    cols = _numeric_cols(df, columns)
    prof = column_profile(df, cols)
    qt = _quantile_table(df, cols, [0.5], ["median"])
    ok = F.col("n_nonnull") >= 2

    def v(c):
        return F.when(ok, F.round(c, R))

    return (prof.join(F.broadcast(qt), "column_name", "left")
            .select("column_name", v(F.col("mean")).alias("mean"), v(F.col("median")).alias("median"),
                    v(F.col("std_samp")).alias("std"), v(F.col("min")).alias("min"), v(F.col("max")).alias("max"),
                    v(F.col("std_samp") * F.col("std_samp")).alias("variance"),
                    v(F.col("skewness")).alias("skewness"), v(F.col("kurtosis")).alias("kurtosis"),
                    F.when(ok, F.round(F.try_divide(F.col("n_null").cast("double"), F.col("n_rows").cast("double")), R))
                    .alias("missing_ratio"),
                    F.when(~ok, F.lit("Insufficient data")).alias("error")))


def outliers_iqr(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values strictly outside [q1 − 1.5·iqr, q3 + 1.5·iqr]; <4 non-null → (0, 0.0)."""
    cols = _numeric_cols(df, columns)
    qt = _quantile_table(df, cols, [0.25, 0.75], ["q1", "q3"]).collect()
    bounds = {r["column_name"]: (r["q1"], r["q3"]) for r in qt}
    aggs = []
    for i, c in enumerate(cols):
        q1, q3 = bounds[c]
        x = qcol(c).cast("double")
        aggs.append(F.count(x).alias(f"n{i}"))
        if q1 is None:
            aggs.append(F.lit(0).cast("long").alias(f"o{i}"))
        else:
            iqr = q3 - q1
            lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
            aggs.append(F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).alias(f"o{i}"))
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("o"))
               for i, c in enumerate(cols)]
    t = wide.select(F.inline(F.array(*structs)))
    small = F.col("n") < 4
    return t.select("column_name",
                    F.when(small, F.lit(0)).otherwise(F.col("o")).cast("long").alias("n_outliers"),
                    F.when(small, F.lit(0.0)).otherwise(F.round(F.try_divide(F.col("o").cast("double"),
                                                                            F.col("n").cast("double")), R))
                    .alias("outlier_ratio"))


def outliers_zscore(df: DataFrame, columns: list[str] | None = None, z: float = 3.0) -> DataFrame:
    """|x − mean| / std_pop > z; <4 non-null → (0, 0.0); zero spread → no outliers."""
    cols = _numeric_cols(df, columns)
    prof = column_profile(df, cols).select("column_name", "mean", "std_pop").collect()
    st = {r["column_name"]: (r["mean"], r["std_pop"]) for r in prof}
    aggs = []
    for i, c in enumerate(cols):
        m, s = st[c]
        x = qcol(c).cast("double")
        aggs.append(F.count(x).alias(f"n{i}"))
        if m is None or s is None:
            aggs.append(F.lit(0).cast("long").alias(f"o{i}"))
        else:
            zs = F.try_divide(F.abs(x - F.lit(m)), F.lit(s))
            aggs.append(F.count_if(F.coalesce(zs > F.lit(z), F.lit(False))).alias(f"o{i}"))
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("o"))
               for i, c in enumerate(cols)]
    t = wide.select(F.inline(F.array(*structs)))
    small = F.col("n") < 4
    return t.select("column_name",
                    F.when(small, F.lit(0)).otherwise(F.col("o")).cast("long").alias("n_outliers"),
                    F.when(small, F.lit(0.0)).otherwise(F.round(F.try_divide(F.col("o").cast("double"),
                                                                            F.col("n").cast("double")), R))
                    .alias("outlier_ratio"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] (value = max folds into the last bin,
    min = max gives one bin), with the column mean and median repeated on each row."""
    x = qcol(column).cast("double")
    st = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("mean")).first()
    med = exact_quantiles(df, [column], [0.5])[column][0]
    mn, mx = st["mn"], st["mx"]
    if mn is None:
        return df.sparkSession.createDataFrame(
            [], "bin int, bin_lo double, bin_hi double, count long, mean double, median double")
    width = (mx - mn) / bins
    if mx == mn:
        b = F.lit(1)
    else:
        b = F.least(F.lit(bins), (F.floor(F.lit(float(bins)) * (x - F.lit(mn)) / F.lit(mx - mn)) + 1).cast("int"))
    return (df.where(x.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin",
                    F.round(F.lit(mn) + (F.col("bin") - 1) * F.lit(width), R).alias("bin_lo"),
                    F.round(F.lit(mn) + F.col("bin") * F.lit(width), R).alias("bin_hi"),
                    "count",
                    F.round(F.lit(st["mean"]), R).alias("mean"),
                    F.round(F.lit(med), R).alias("median"))
            .orderBy("bin"))


def _agg_scalars(df: DataFrame, named: list, budget: int = 32) -> dict:
    """Evaluate many scalar aggregates in column-chunked passes (each pass reads only the columns
    it needs and stays small enough for whole-stage codegen); returns {alias: value}."""
    out = {}
    for i in range(0, len(named), budget):
        part = named[i:i + budget]
        row = df.agg(*[e.alias(a) for a, e in part]).first()
        out.update({a: row[a] for a, _ in part})
    return out


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r for every ordered pair, pairwise-complete, in long form (x, y, r).

    Plain sums of mean-shifted values (no cancellation): for columns without NULLs the
    per-column sums serve every pair and each pair adds one cross-product sum; pairs involving
    a column with NULLs get their own sums over the rows where both are present.
    r = (Sxy − Sx·Sy/n) / sqrt((Sxx − Sx²/n)(Syy − Sy²/n)); zero spread → NULL (no ANSI error).
    The result has #columns² rows. Fewer than two numeric columns → empty table.
    """
    import math
    cols = _numeric_cols(df, columns)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "x string, y string, r double")
    first = _agg_scalars(df, [(f"m{i}", F.avg(qcol(c).cast("double"))) for i, c in enumerate(cols)]
                         + [(f"c{i}", F.count(qcol(c))) for i, c in enumerate(cols)] + [("n", F.count(F.lit(1)))])
    n_all = first["n"]
    complete = [first[f"c{i}"] == n_all for i in range(len(cols))]
    dx = [qcol(c).cast("double") - F.lit(first[f"m{i}"] if first[f"m{i}"] is not None else 0.0) for i, c in enumerate(cols)]
    named = []
    for i in range(len(cols)):
        if complete[i]:
            named += [(f"s{i}", F.sum(dx[i])), (f"q{i}", F.sum(dx[i] * dx[i]))]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    for i, j in pairs:
        if complete[i] and complete[j]:
            named.append((f"x{i}_{j}", F.sum(dx[i] * dx[j])))
        else:
            both = qcol(cols[i]).isNotNull() & qcol(cols[j]).isNotNull()
            a, b = F.when(both, dx[i]), F.when(both, dx[j])
            named += [(f"n{i}_{j}", F.count_if(both)), (f"a{i}_{j}", F.sum(a)), (f"b{i}_{j}", F.sum(b)),
                      (f"x{i}_{j}", F.sum(a * b)), (f"aa{i}_{j}", F.sum(a * a)), (f"bb{i}_{j}", F.sum(b * b))]
    v = _agg_scalars(df, named)
    rows = []
    for i, j in pairs:
        if complete[i] and complete[j]:
            n, sa, sb, saa, sbb = n_all, v[f"s{i}"], v[f"s{j}"], v[f"q{i}"], v[f"q{j}"]
        else:
            n, sa, sb, saa, sbb = (v[f"n{i}_{j}"], v[f"a{i}_{j}"], v[f"b{i}_{j}"], v[f"aa{i}_{j}"], v[f"bb{i}_{j}"])
        sab = v[f"x{i}_{j}"]
        r = None
        if n and sab is not None:
            cov = sab - sa * sb / n
            va, vb = saa - sa * sa / n, sbb - sb * sb / n
            den = math.sqrt(va * vb) if va > 0 and vb > 0 else 0.0
            r = round(cov / den, R) if den > 0 else None
        rows.append((cols[i], cols[j], r))
        if i != j:
            rows.append((cols[j], cols[i], r))
    return spark.createDataFrame(rows, "x string, y string, r double")


def summary_table(df: DataFrame) -> DataFrame:
    """One row per numeric or categorical column (Type, Non-Null, Missing; Mean/Std/Min/Max
    for numeric; Unique, Mode and top category for categorical)."""
    classes = classify(df)
    num = [c for c, k in classes if k == NUMERIC]
    cat = [c for c, k in classes if k == CATEGORICAL]
    prof = column_profile(df, num + cat)
    out = prof.select("position", "column_name",
                      F.when(F.col("cls") == NUMERIC, "Numeric").otherwise("Categorical").alias("type"),
                      F.col("n_nonnull").cast("long").alias("non_null"), F.col("n_null").cast("long").alias("missing"),
                      F.round("mean", R).alias("mean"), F.round("std_samp", R).alias("std"),
                      F.round("min", R).alias("min"), F.round("max", R).alias("max"))
    if cat:
        freq = frequency_table(df, cat)
        dc = distinct_counts(freq).select("position", F.col("n_distinct").cast("long").alias("unique"))
        mode = top_values(freq, 1).select("position", F.col("value").alias("mode"))
        out = out.join(dc, "position", "left").join(mode, "position", "left")
    else:
        out = out.withColumn("unique", F.lit(None).cast("long")).withColumn("mode", F.lit(None).cast("string"))
    return out.select("column_name", "type", "non_null", "missing", "mean", "std", "min", "max", "unique",
                      "mode", F.col("mode").alias("top_category"))


__all__ = ["describe_numeric", "feature_distribution", "outliers_iqr", "outliers_zscore", "histogram",
           "correlation_matrix", "summary_table", "combine_scalars"]


def univariate(df: DataFrame, column: str) -> DataFrame:
    """The chart table for one column — histogram for numeric, value counts for categorical."""
    from .profile import value_counts
    cls = dict(classify(df))[column]
    if cls == NUMERIC:
        return histogram(df, column)
    if cls == CATEGORICAL:
        return value_counts(df, column)
    raise ValueError(f"Column {column!r} is neither numeric nor categorical")
