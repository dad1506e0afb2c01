"""Sinks: labelled result tables (IO6). Models are saved by ``operators.train.save_model`` (IO4).

Paths default to a folder under the session's checkpoint directory, i.e. shared storage the
cluster names — never a machine-local temporary folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def results_dir(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/results/{name}"


def write_labelled(df: DataFrame, name: str, path: str | None = None) -> str:
    """Write ``row_id, features…, cluster`` as Parquet and return the path."""
    out = path or results_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(out)
    return out
