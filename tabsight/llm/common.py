"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.session import ensure_checkpoint_dir, ship

__all__ = ["give_back", "packed", "read", "ship", "stored", "train_split"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, through Spark's reader (the directory may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """In a Python worker at the end of a task: return freed memory to the system, as Spark keeps the
    process for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: lineage is cut and
    later plans reuse the rows, also after an executor is lost."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **parts: str) -> DataFrame:
    """The row as one struct ``__row`` beside the named inputs, so that extra columns of
    ``df`` cannot clash with an operator's own; ``select("__row.*")`` restores it."""
    return df.select(F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias("__row"),
                     *[F.col(_quoted(c)).alias(alias) for alias, c in parts.items()])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def train_split() -> F.Column:
    """True for rows that a model may learn from: crc32(doc_id as text) mod 4 is not 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
