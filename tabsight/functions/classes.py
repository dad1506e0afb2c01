"""Type classes of columns, decided from the Spark schema alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
BOOLEAN = "boolean"
DATETIME = "datetime"
OTHER = "other"

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                  T.DecimalType)
_DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def classify_type(dt: T.DataType) -> str:
    if isinstance(dt, _NUMERIC_TYPES):
        return NUMERIC
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return CATEGORICAL
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if isinstance(dt, _DATETIME_TYPES):
        return DATETIME
    return OTHER


def classify(df: DataFrame) -> list[tuple[str, str]]:
    """(column, class) in schema order."""
    return [(f.name, classify_type(f.dataType)) for f in df.schema.fields]


def columns_of(df: DataFrame, cls: str) -> list[str]:
    return [n for n, c in classify(df) if c == cls]


def stats_numeric(cls: str) -> bool:
    """Classes whose screening uses mean/std (booleans count as numeric there)."""
    return cls in (NUMERIC, BOOLEAN)
