"""Parquet table scans for the test-data layout ``{sf_dir}/{name}.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.safe import normalize_missing

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, normalize: bool = True) -> DataFrame:
    """Scan one table. NaN is normalised to NULL so NULL is the only missing marker."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return normalize_missing(df) if normalize else df
