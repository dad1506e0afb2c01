"""Column profile and frequency table — the two shared tables every report is projected from.

* ``column_profile``: one global aggregate per chunk of columns (Parquet prunes each chunk's
  scan to its own columns, so chunking costs no extra I/O; small chunks keep the generated
  code inside whole-stage codegen), unpivoted to one row per column.
* ``frequency_table``: every (column, value) pair with its count, built by unpivoting the
  columns into (position, value-as-string) and a map-side-combined ``groupBy``. Distinct
  counts, modes, top-k and value counts are all projections of it.

Both are plain DataFrames; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import (BOOLEAN, CATEGORICAL, NUMERIC, classify, stats_numeric)
from ..functions.safe import qcol

CHUNK = 64          # at most this many columns per aggregate
AGG_BUDGET = 32     # and at most this many aggregate expressions, so generated code stays small

PROFILE_COLUMNS = ["position", "column_name", "cls", "n_rows", "n_nonnull", "n_null", "mean",
                   "std_samp", "std_pop", "min", "max", "skewness", "kurtosis"]


def _chunks(items: list, size: int = CHUNK, weight=None, budget: int = AGG_BUDGET):
    """Split columns into chunks of ≤ ``size`` columns and ≤ ``budget`` aggregate expressions.
    Each chunk is one scan, but Parquet reads only that chunk's columns, so the total I/O is
    the same as one wide aggregate while whole-stage codegen keeps working."""
    cur, load = [], 0
    for it in items:
        w = weight(it) if weight else 1
        if cur and (len(cur) >= size or load + w > budget):
            yield cur
            cur, load = [], 0
        cur.append(it)
        load += w
    if cur:
        yield cur


def _null_double():
    return F.lit(None).cast("double")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: position, name, class, row/null counts and moments (numeric, boolean)."""
    classes = dict(classify(df))
    cols = list(columns) if columns is not None else list(df.columns)
    pos_of = {c: i for i, c in enumerate(df.columns)}
    parts = []
    for chunk in _chunks(cols, weight=lambda c: 8 if stats_numeric(classes[c]) else 1):
        aggs = [F.count(F.lit(1)).alias("n_rows")]
        for c in chunk:
            i = pos_of[c]
            x = qcol(c)
            aggs.append(F.count(x).alias(f"nn{i}"))
            if stats_numeric(classes[c]):
                xd = x.cast("int").cast("double") if classes[c] == BOOLEAN else x.cast("double")
                aggs += [F.avg(xd).alias(f"mean{i}"), F.stddev_samp(xd).alias(f"sds{i}"),
                         F.stddev_pop(xd).alias(f"sdp{i}"), F.min(xd).alias(f"min{i}"),
                         F.max(xd).alias(f"max{i}"), F.skewness(xd).alias(f"sk{i}"),
                         F.kurtosis(xd).alias(f"ku{i}")]
        wide = df.agg(*aggs)
        structs = []
        for c in chunk:
            i = pos_of[c]
            num = stats_numeric(classes[c])

            def g(prefix):
                return F.col(f"{prefix}{i}") if num else _null_double()

            structs.append(F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(classes[c]).alias("cls"),
                F.col(f"nn{i}").alias("n_nonnull"), g("mean").alias("mean"), g("sds").alias("std_samp"),
                g("sdp").alias("std_pop"), g("min").alias("min"), g("max").alias("max"),
                g("sk").alias("skewness"), g("ku").alias("kurtosis")))
        parts.append(wide.select("n_rows", F.inline(F.array(*structs))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "position", "column_name", "cls", "n_rows", "n_nonnull",
        (F.col("n_rows") - F.col("n_nonnull")).alias("n_null"),
        "mean", "std_samp", "std_pop", "min", "max", "skewness", "kurtosis")


def stacked_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, value) with every cell rendered as a string — the unpivoted table."""
    cols = list(columns) if columns is not None else list(df.columns)
    pos_of = {c: i for i, c in enumerate(df.columns)}

    floating = {c: t for c, t in df.dtypes if t in ("double", "float")}

    def val(c):
        return (qcol(c) + F.lit(0.0).cast(floating[c]) if c in floating else qcol(c)).cast("string")  # -0.0 is 0.0

    return df.select(F.inline(F.array(*[
        F.struct(F.lit(pos_of[c]).alias("position"), val(c).alias("value")) for c in cols
    ])))


def frequency_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column_name, value, cnt); NULL is one value of its own."""
    cols = list(columns) if columns is not None else list(df.columns)
    names = F.array(*[F.lit(c) for c in df.columns])
    return (stacked_values(df, cols)
            .groupBy("position", "value").agg(F.count(F.lit(1)).alias("cnt"))
            .select("position", F.element_at(names, F.col("position") + 1).alias("column_name"),
                    "value", "cnt"))


def distinct_counts(freq: DataFrame) -> DataFrame:
    """(position, n_distinct excluding NULL, has_null 0/1, n_rows) from the frequency table."""
    return freq.groupBy("position").agg(
        F.count("value").alias("n_distinct"),
        F.max(F.col("value").isNull().cast("int")).alias("has_null"),
        F.sum("cnt").alias("n_rows"))


EIGHT_BYTES = ("bigint", "double", "int", "smallint", "tinyint", "float", "boolean", "date", "timestamp", "timestamp_ntz")


def hashed_frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, value, cnt) for counting only: ``value`` is a 64-bit hash, which no two values of a type of
    at most eight bytes share, beside a second one for the others (128 bits in all: collisions are negligible, ~n²/2¹²⁹). Keys are of
    fixed width, so neither texts nor rendered numbers are shuffled."""
    cols = list(columns) if columns is not None else list(df.columns)
    types, position = dict(df.dtypes), {c: i for i, c in enumerate(df.columns)}

    def keys(c):
        v = qcol(c) + F.lit(0.0).cast(types[c]) if types[c] in ("double", "float") else qcol(c)  # -0.0 is 0.0
        more = F.lit(0).cast("long") if types[c] in EIGHT_BYTES else F.xxhash64(F.lit("more"), v)
        return F.struct(F.lit(position[c]).alias("position"), F.when(v.isNotNull(), F.xxhash64(v)).alias("value"), more.alias("more"))

    cells = df.select(F.inline(F.array(*[keys(c) for c in cols])))
    return cells.groupBy("position", "value", "more").agg(F.count(F.lit(1)).alias("cnt"))


def full_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Column profile joined with exact distinct counts (both sides have one row per column)."""
    prof = column_profile(df, columns)
    dc = distinct_counts(hashed_frequencies(df, columns)).drop("n_rows")
    return (prof.join(F.broadcast(dc), "position", "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)).cast("long"))
            .withColumn("has_null", F.coalesce("has_null", F.lit(0))))


def top_values(freq: DataFrame, k: int = 5, numeric_order: bool = False) -> DataFrame:
    """Top-k non-null values per column by count desc, value asc.

    The rank filter lets Spark insert a map-side WindowGroupLimit, so each map task ships
    at most k rows per column to the window, however many distinct values a column has.
    """
    order_value = F.col("value").cast("double") if numeric_order else F.col("value")
    w = Window.partitionBy("position").orderBy(F.desc("cnt"), order_value.asc())
    return (freq.where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


# --------------------------------------------------------------------------- reports


def combine_scalars(*frames: DataFrame) -> DataFrame:
    """Put single-row frames with disjoint columns side by side without a join:
    union them (each padded with NULLs) and take the one non-null value per column."""
    names = [c for f in frames for c in f.columns]
    types = {fld.name: fld.dataType for f in frames for fld in f.schema.fields}
    padded = [f.select(*[(F.col(c) if c in f.columns else F.lit(None).cast(types[c])).alias(c) for c in names])
              for f in frames]
    u = padded[0]
    for p in padded[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.max(c).alias(c) for c in names])


def overview_metrics(df: DataFrame) -> DataFrame:
    """A1–A4: records, features, numeric, categorical, missing %, duplicates, high-cardinality."""
    classes = classify(df)
    n_cols = len(df.columns)
    prof = full_profile(df)
    per_col = prof.agg(
        F.sum("n_null").alias("null_cells"),
        F.first("n_rows").alias("n_rows"),
        F.sum(F.when(F.try_divide((F.col("n_distinct") + F.col("has_null")).cast("double"),
                                  F.col("n_rows").cast("double")) > 0.95, 1).otherwise(0)).alias("n_high_card"))
    dups = duplicate_count(df).select("duplicates")
    return combine_scalars(per_col, dups).select(
        F.col("n_rows").cast("long").alias("n_records"),
        F.lit(n_cols).cast("long").alias("n_features"),
        F.lit(sum(1 for _, c in classes if c == NUMERIC)).cast("long").alias("n_numeric"),
        F.lit(sum(1 for _, c in classes if c == CATEGORICAL)).cast("long").alias("n_categorical"),
        F.round(F.coalesce(F.try_divide(F.col("null_cells").cast("double") * 100.0,
                                        F.col("n_rows").cast("double") * n_cols), F.lit(0.0)), 6).alias("missing_pct"),
        F.col("duplicates").cast("long").alias("duplicates"),
        F.col("n_high_card").cast("long").alias("n_high_card"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """A3: rows beyond the first of each identical group (NULLs equal); one shuffle, map-side combined."""
    cols = [qcol(c) for c in df.columns]
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("cnt"))
    return groups.agg(
        F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("duplicates"),
        F.count(F.lit(1)).cast("long").alias("n_distinct_rows"),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("n_rows"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing % per column, only columns with missing values, largest first."""
    prof = column_profile(df)
    return (prof.select(
        "column_name",
        F.col("n_null").cast("long").alias("n_missing"),
        F.round(F.try_divide(F.col("n_null").cast("double") * 100.0, F.col("n_rows").cast("double")), 6)
        .alias("missing_pct"))
        .where(F.col("n_missing") > 0)
        .orderBy(F.desc("missing_pct"), "column_name"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per non-null value, descending (ties by value)."""
    x = qcol(column)
    return (df.where(x.isNotNull()).groupBy(x.alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "value"))


def category_distribution(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """Per categorical column distinct (non-null), mode (smallest on tie), missing ratio, top-k."""
    cols = columns or [c for c, cls in classify(df) if cls == CATEGORICAL]
    freq = frequency_table(df, cols)
    top = top_values(freq, k)
    dc = distinct_counts(freq)
    mode = top.where(F.col("rank") == 1).select("position", F.col("value").alias("mode"))
    nulls = freq.where(F.col("value").isNull()).select("position", F.col("cnt").alias("n_null"))
    tops = top.groupBy("position").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))),
                                 lambda s: F.concat(s["value"], F.lit("="), s["cnt"].cast("string"))),
                     "; ").alias("top_values"))
    names = F.array(*[F.lit(c) for c in df.columns])
    return (dc.join(mode, "position", "left").join(nulls, "position", "left").join(tops, "position", "left")
            .select(F.element_at(names, F.col("position") + 1).alias("column_name"),
                    F.col("n_distinct").cast("long").alias("n_distinct"), "mode",
                    F.round(F.coalesce(F.try_divide(F.coalesce("n_null", F.lit(0)).cast("double"),
                                                    F.col("n_rows").cast("double")), F.lit(0.0)), 6)
                    .alias("missing_ratio"),
                    "top_values"))
