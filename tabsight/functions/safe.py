"""ANSI-safe arithmetic and null normalisation.

Sessions run with ANSI mode on, so no bare division: every ratio goes through
``try_divide`` (NULL on a zero denominator) or ``nullif``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col_(a), col_(b))


def nan_to_null(c: str | Column) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def inf_to_null(c: str | Column) -> Column:
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN → NULL for float/double columns (NULL is the only missing marker downstream)."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(nan_to_null(F.col(f"`{f.name}`")).alias(f.name))
            changed = True
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs) if changed else df


def qcol(name: str) -> Column:
    """Column by name, quoted so names with dots or spaces work."""
    return F.col("`" + name.replace("`", "``") + "`")
