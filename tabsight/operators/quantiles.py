"""Exact linear-interpolation quantiles (pandas / numpy ``linear`` definition) by radix selection.

A double's bits, turned so that they sort as the doubles do, are read as four digits of 16 bits. Each
of four passes counts, inside the tasks, the next digit of the values that agree with the digits found so
far, for all columns and all ranks asked for at once; the counts are summed over the tasks and the digit in which a
rank falls is found by a running sum over at most 2^16 rows. After the last pass the digits are the value itself.

Memory is fixed: at most ``CELLS`` counts a task, whatever the number of rows or of distinct values; columns that need more
go in several turns. Only a digit and two counts per column and rank reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import qcol

BITS, PASSES = 16, 4
CELLS = 1 << 22
_SIGN = np.uint64(1 << 63)


def sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 is 0.0; NaN is above infinity, as in Spark)."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_sortable(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digit_counts(values: DataFrame, done: int, prefixes: list[list[int]]) -> DataFrame:
    """(``c``, ``prefix``, ``digit``, ``n``): counts of the digit after ``done`` digits, of the values of column
    c that begin with its prefix number ``prefix``."""
    shift = np.uint64(64 - BITS * (done + 1))
    width = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((len(p), width), np.int64) for p in prefixes]
        for batch in batches:
            flat = batch.column(0).flatten()
            table = flat.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            held = flat.is_valid().to_numpy(zero_copy_only=False).reshape(table.shape)
            for c, wanted in enumerate(prefixes):
                if not wanted or not held[:, c].any():
                    continue
                keys = sortable(table[held[:, c], c])
                digits = ((keys >> shift) & np.uint64(width - 1)).astype(np.int64)
                if done == 0:
                    counts[c][0] += np.bincount(digits, minlength=width)
                    continue
                heads = keys >> (shift + np.uint64(BITS))
                for i, head in enumerate(wanted):
                    counts[c][i] += np.bincount(digits[heads == np.uint64(head)], minlength=width)
        for c, table in enumerate(counts):
            some = np.nonzero(table)
            if len(some[0]):
                yield pa.record_batch([pa.array(np.full(len(some[0]), c, np.int32)), pa.array(some[0].astype(np.int32)),
                                       pa.array(some[1].astype(np.int32)), pa.array(table[some])], ["c", "prefix", "digit", "n"])

    return values.mapInArrow(run, "c int, prefix int, digit int, n long").groupBy("c", "prefix", "digit").agg(F.sum("n").alias("n"))


def _select(values: DataFrame, n_columns: int, probs: list[float]) -> list[list[float] | None]:
    """The quantiles of the elements of ``values``' one column, an array of ``n_columns`` doubles."""
    spark = values.sparkSession
    sizes: list[int] = [0] * n_columns
    targets: list[dict[int, tuple[int, int]]] = [{} for _ in range(n_columns)]  # rank -> (digits so far, rank among their values)
    for done in range(PASSES):
        prefixes = [sorted({head for head, _ in t.values()}) if done else [0] for t in targets]
        counts = _digit_counts(values, done, prefixes)
        w = Window.partitionBy("c", "prefix").orderBy("digit")  # at most 2^16 rows each
        running = counts.select("*", F.sum("n").over(w).alias("upto"))
        if done == 0:
            running = running.persist()
            for r in running.groupBy("c").agg(F.sum("n").alias("n")).collect():
                sizes[r["c"]] = r["n"]
            for c, n in enumerate(sizes):
                for p in probs if n else []:
                    at = p * (n - 1)
                    targets[c] |= {k: (0, k) for k in (math.floor(at), math.ceil(at))}
        asked = [(c, prefixes[c].index(head), k, rest) for c, t in enumerate(targets) for k, (head, rest) in t.items()]
        if not asked:
            return [None] * n_columns
        ranks = spark.createDataFrame(asked, "c int, prefix int, k long, rest long")
        hits = running.join(F.broadcast(ranks), ["c", "prefix"]).where("rest < upto AND rest >= upto - n")
        for r in hits.select("c", "k", "digit", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")).collect():
            head = targets[r["c"]][r["k"]][0]
            targets[r["c"]][r["k"]] = ((head << BITS) + r["digit"], r["left"])
        if done == 0:
            running.unpersist()
    out: list[list[float] | None] = []
    for c, n in enumerate(sizes):
        row = []
        for p in probs if n else []:
            at = p * (n - 1)
            low, high = math.floor(at), math.ceil(at)
            a, b = (from_sortable(targets[c][k][0]) for k in (low, high))
            row.append(a if low == high or a == b else (high - at) * a + (at - low) * b)
        out.append(row or None)
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict:
    """{column: [q(p) for p in probs]} with NULLs ignored; [None, …] for an all-null column."""
    if not cols or not probs:
        return {c: [] for c in cols}
    at_once = max(1, CELLS // (2 * len(probs) << BITS))
    out = {}
    for start in range(0, len(cols), at_once):
        some = cols[start:start + at_once]
        # one array, not a column each: Spark infers a filter's constraints anew for every subset of aliased columns
        values = df.select(F.array(*[qcol(c).cast("double") for c in some]).alias("v"))
        for c, row in zip(some, _select(values, len(some), probs), strict=True):
            out[c] = row if row is not None else [None] * len(probs)
    return out
