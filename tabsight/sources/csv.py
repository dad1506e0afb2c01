"""CSV scan with pandas-like type narrowing (IO1).

Spark reads every column as a string; one global aggregate then counts, per column, how many
non-missing cells parse as integer, as floating point and as a boolean token, and a single
projection casts each column to the narrowest type all its cells fit:

* every cell an integer → ``long`` (``double`` when the column has missing cells),
* every cell a number → ``double`` (an all-missing column is ``double`` too),
* every cell a boolean token → ``boolean`` (string when missing cells are present),
* otherwise ``string``; dates stay text.

``inferSchema`` is not used: it would give dates, keep "NA" as text and rename duplicate
headers by position. Duplicate header names become ``name``, ``name.1``, ``name.2`` …
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import qcol

# Cell texts read as missing (the default NA tokens of common CSV readers).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Boolean tokens.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


def dedupe_header(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            cand = f"{n}.{seen[n]}"
            while cand in seen:
                seen[n] += 1
                cand = f"{n}.{seen[n]}"
            seen[cand] = 0
            out.append(cand)
        else:
            seen[n] = 0
            out.append(n)
    return out


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    reader = spark.read.options(sep=sep, quote='"', escape='"', multiLine=True)  # quotes doubled, lines inside quotes
    raw = reader.options(header=True, inferSchema=False, nullValue="", emptyValue="", mode="PERMISSIVE").csv(path)
    header = reader.options(header=False).csv(path).first()
    names = dedupe_header([str(v) if v else f"Unnamed: {i}" for i, v in enumerate(header)]) if header else raw.columns
    raw = raw.toDF(*names)
    na = F.array(*[F.lit(t) for t in NA_TOKENS])
    clean = raw.select(*[F.when(F.array_contains(na, qcol(c)) | qcol(c).isNull(), F.lit(None).cast("string"))
                         .otherwise(qcol(c)).alias(c) for c in names])
    booleans = F.array(*[F.lit(t) for t in TRUE_TOKENS + FALSE_TOKENS])
    aggs = []
    for i, c in enumerate(names):
        x = qcol(c)
        aggs += [F.count(x).alias(f"n{i}"), F.count(x.try_cast("bigint")).alias(f"l{i}"),
                 F.count(x.try_cast("double")).alias(f"d{i}"),
                 F.count_if(F.array_contains(booleans, x)).alias(f"b{i}")]
    aggs.append(F.count(F.lit(1)).alias("rows"))
    st = clean.agg(*aggs).first()
    out = []
    trues = F.array(*[F.lit(t) for t in TRUE_TOKENS])
    for i, c in enumerate(names):
        n, rows = st[f"n{i}"], st["rows"]
        x = qcol(c)
        if n == 0:
            out.append(x.cast("double").alias(c))
        elif st[f"l{i}"] == n:
            out.append(x.try_cast("bigint").cast("long" if n == rows else "double").alias(c))
        elif st[f"d{i}"] == n:
            out.append(x.try_cast("double").alias(c))
        elif st[f"b{i}"] == n and n == rows:
            out.append(F.array_contains(trues, x).alias(c))
        else:
            out.append(x.alias(c))
    return clean.select(*out)
