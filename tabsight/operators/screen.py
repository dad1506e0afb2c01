"""Column screening (P2–P12): which columns are unusable as features, and why.

The verdict is a projection of the column profile: name rules first (evaluated on the
column catalogue, so a column dropped by name never needs its distinct count), then high
cardinality, then near-constant. The exact distinct count is computed only for columns that
reach the cardinality rules, from the shared frequency table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.classes import classify, stats_numeric
from .profile import column_profile, distinct_counts, hashed_frequencies


def high_cardinality_col(n_distinct: Column, has_null: Column, n_rows: Column, threshold: float = 0.95) -> Column:
    """P5: (distinct + NULL-as-a-value) / rows > threshold; empty column → False."""
    ratio = F.try_divide((n_distinct + has_null).cast("double"), n_rows.cast("double"))
    return F.coalesce(ratio > F.lit(threshold), F.lit(False))


def near_constant_col(cls: Column, n_rows: Column, n_nonnull: Column, n_distinct: Column, mean: Column,
                      std_samp: Column, threshold: float = 0.01) -> Column:
    """Fewer than 2 rows / non-nulls → True; text: distinct/non-null < 0.01;
    numeric: |mean| < 1e-10 → std < 1e-10, else |std/mean| < threshold."""
    numeric = cls.isin("numeric", "boolean")
    cv = F.abs(F.try_divide(std_samp, mean))
    num_rule = F.when(F.abs(mean) < F.lit(1e-10), std_samp < F.lit(1e-10)).otherwise(cv < F.lit(threshold))
    text_rule = F.try_divide(n_distinct.cast("double"), n_nonnull.cast("double")) < F.lit(0.01)
    return (F.when(n_rows < 2, F.lit(True))
            .when(n_nonnull < 2, F.lit(True))
            .when(numeric, F.coalesce(num_rule, F.lit(False)))
            .otherwise(F.coalesce(text_rule, F.lit(False))))


def screen_columns(df: DataFrame, target_col: str | None = None, id_threshold: float = 0.95,
                   constant_threshold: float = 0.01) -> DataFrame:
    """One row per column: (position, column_name, cls, n_distinct, reason); reason NULL = kept.

    ``n_distinct`` counts NULL as a value (as the high-cardinality rule does) and is NULL for
    columns decided by name alone.
    """
    classes = classify(df)
    by_name = {c: N.name_reason(c) for c, _ in classes}
    needs_stats = [c for c, _ in classes if by_name[c] is None]
    prof = column_profile(df)
    if needs_stats:
        dc = distinct_counts(hashed_frequencies(df, needs_stats)).drop("n_rows")
        prof = prof.join(F.broadcast(dc), "position", "left")
    else:
        prof = prof.withColumn("n_distinct", F.lit(None).cast("long")).withColumn("has_null", F.lit(None).cast("int"))
    name_reason = N.name_reason_col(F.col("column_name"))
    hc = high_cardinality_col(F.col("n_distinct"), F.col("has_null"), F.col("n_rows"), id_threshold)
    nc = near_constant_col(F.col("cls"), F.col("n_rows"), F.col("n_nonnull"), F.col("n_distinct"),
                           F.col("mean"), F.col("std_samp"), constant_threshold)
    n_unique = (F.col("n_distinct") + F.col("has_null")).cast("long")
    reason = (F.when(name_reason.isNotNull(), name_reason)
              .when(hc, F.format_string(N.REASON_HIGH_CARD.replace("{n}", "%d"), n_unique))
              .when(nc, F.lit(N.REASON_CONSTANT)))
    if target_col is not None:
        reason = F.when(F.col("column_name") == F.lit(target_col), F.lit(None).cast("string")).otherwise(reason)
    return prof.select("position", "column_name", "cls",
                       F.when(name_reason.isNull(), n_unique).alias("n_distinct"),
                       reason.alias("reason"))


def removed_features(screen: DataFrame) -> DataFrame:
    """(column_name, reason) for removed columns."""
    return screen.where(F.col("reason").isNotNull()).select("column_name", "reason")


def clean_columns(screen: DataFrame) -> list[str]:
    """Names kept by the screen, in schema order (a list of column names, size = #columns)."""
    return [r["column_name"] for r in
            screen.where(F.col("reason").isNull()).orderBy("position").select("column_name").collect()]


def validate_and_clean(df: DataFrame, target_col: str | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """Drop the screened columns; returns (clean frame, screen table)."""
    screen = screen_columns(df, target_col, **kw).cache()
    keep = clean_columns(screen)
    return df.select(*[F.col(f"`{c}`") for c in keep]), screen


def detect_feature_leakage(df: DataFrame) -> list[str]:
    """P10: the columns the screen would remove (no target)."""
    return [r["column_name"] for r in removed_features(screen_columns(df)).collect()]


def prep_drop_columns(df: DataFrame, exclude_cols: list[str] | None = None,
                      target_col: str | None = None) -> list[str]:
    """Exclude ∪ preprocessing ID rule ∪ target, only columns present; error when nothing is left."""
    drop = set(exclude_cols or [])
    drop.update(c for c in df.columns if N.is_prep_id_name(c))
    if target_col:
        drop.add(target_col)
    present = [c for c in df.columns if c in drop]
    if len(present) == len(df.columns):
        raise ValueError("No usable features remain after preprocessing")
    return present


def prep_id_col(name: Column) -> Column:
    """P11 as a Column over a string column of names."""
    return name.rlike(N.PREP_ID_PATTERN)


def column_classes(df: DataFrame) -> list[tuple[str, str]]:
    """(column, class); eligible targets are the numeric ones."""
    return classify(df)


__all__ = ["screen_columns", "removed_features", "validate_and_clean", "detect_feature_leakage",
           "prep_drop_columns", "column_classes", "clean_columns", "stats_numeric"]
