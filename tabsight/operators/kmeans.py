"""k-means with restarts and automatic k (M5, M6), all restarts of all k in one batched Lloyd loop.

Every (k, restart) pair is a set of centres. One Spark job a step assigns the rows to the nearest
centre of each set that still moves and sums, per centre, rows, coordinates and squared norms; only
these (centres x columns) sums reach the driver, and sets that have converged drop out. Starts
are k-means|| over all rows: in each of ``ROUNDS`` passes every restart draws ``OVERSAMPLE`` x k more
candidates, a row in proportion to its squared distance from those it has (by a hash of its key, so
starts do not depend on the partitioning); the candidates, weighted by the rows nearest to them, are
reduced by k-means++ on the driver. k is chosen by the squared-Euclidean silhouette (linear time, see
``cluster_metrics``), which one more job works out for the best restart of every k; the smallest k
wins ties. A k with fewer rows than centres is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import qcol
from ..session import ship

ROUNDS, OVERSAMPLE = 5, 2  # passes that draw candidates for starting centres, and candidates a pass over k
ROWS_PER_TASK = 50_000  # tasks of a step: rows over this


def standardize(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """(x − mean) / std_pop with zero spread → 1 (the re-scaling applied before clustering)."""
    st = df.agg(*[F.avg(qcol(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(qcol(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return df.select(*[qcol(k) for k in (keep or [])],
                     *[((qcol(c) - F.lit(st[f"m{i}"] or 0.0)) / F.lit(st[f"s{i}"] or 1.0)).alias(c)
                       for i, c in enumerate(cols)])


@dataclass
class CentreSet:
    """The centres of one (k, restart)."""

    k: int
    restart: int
    centres: np.ndarray
    counts: np.ndarray | None = None
    sums: np.ndarray | None = None
    norms: np.ndarray | None = None

    @property
    def cost(self) -> float:
        """Squared distances to the centres, from the sums of the last assignment."""
        c = self.centres
        return float((self.norms - 2 * (c * self.sums).sum(1) + self.counts * (c * c).sum(1)).sum())


def _uniform(hashes: np.ndarray, restart: int, step: int) -> np.ndarray:
    """In (0, 1), from a row's hash (splitmix64)."""
    z = hashes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (restart * (ROUNDS + 1) + step + 1)) % 2 ** 64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(float) / 2 ** 53 + 2.0 ** -54


def _draw(hashed: DataFrame, found: list[np.ndarray], step: int, many: int, d: int) -> list[np.ndarray]:
    """For each restart ``many`` rows without replacement, in proportion to the squared distance from those
    found (evenly if there are none): the smallest -log(u) / distance. One pass; each task keeps its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, d)))] * len(found)
        for batch in batches:
            hashes, x = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
            for r, centres in enumerate(found):
                gap = np.full(len(x), np.inf if len(centres) else 1.0)
                for c in centres:
                    np.minimum(gap, ((x - c) ** 2).sum(1), out=gap)
                some = np.flatnonzero(gap > 0)
                score = -np.log(_uniform(hashes[some], r, step)) / gap[some]
                score, h, rows = (np.concatenate(p) for p in zip(best[r], (score, hashes[some], x[some])))
                first = np.lexsort((h, score))[:many]
                best[r] = score[first], h[first], rows[first]
        score, h, rows = (np.concatenate(p) for p in zip(*best))
        restart = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        features = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * d, pa.int32()), pa.array(rows.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(restart), pa.array(score), pa.array(h), features],
                                         names=["restart", "score", "h", "features"])

    place = F.row_number().over(Window.partitionBy("restart").orderBy("score", "h"))
    rows = (hashed.mapInArrow(run, "restart long, score double, h long, features array<double>")
            .withColumn("place", place).where(F.col("place") <= many).orderBy("restart", "place").collect())
    return [np.array([r["features"] for r in rows if r["restart"] == i], float).reshape(-1, d) for i in range(len(found))]


def _starts(vec: DataFrame, key: str, ks: list[int], n_init: int, seed: int, d: int) -> list[CentreSet]:
    hashed = vec.select(F.xxhash64(qcol(key), F.lit(seed)).alias("h"), "features")
    found = [np.zeros((0, d))] * n_init
    for step in range(ROUNDS + 1):
        drawn = _draw(hashed, found, step, OVERSAMPLE * max(ks) if step else 1, d)
        found = [np.vstack(p) for p in zip(found, drawn)]
    pools = [CentreSet(len(x), restart, x) for restart, x in enumerate(found)]
    _step(vec, pools, d)
    sets = []
    for restart, pool in enumerate(pools):
        rng = np.random.default_rng([seed, restart])
        x, weight = pool.centres, pool.counts
        chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
        gap = ((x - x[chosen[0]]) ** 2).sum(1)
        while len(chosen) < max(ks):
            total = (weight * gap).sum()
            pick = int(rng.choice(len(x), p=weight * gap / total)) if total > 0 else int(rng.integers(len(x)))
            chosen.append(pick)
            gap = np.minimum(gap, ((x - x[pick]) ** 2).sum(1))
        sets += [CentreSet(k, restart, x[chosen[:k]].copy()) for k in ks]
    return sets


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def _step(vec: DataFrame, sets: list[CentreSet], d: int) -> None:
    """Assign every row in each set and put the new sums into the sets."""
    centres = [s.centres for s in sets]
    firsts = np.cumsum([0] + [len(c) for c in centres])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((firsts[-1], d + 2))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            wide = np.hstack([np.ones((len(x), 1)), (x * x).sum(1, keepdims=True), x])
            for first, c in zip(firsts, centres):
                own = np.zeros((len(x), len(c)))
                own[np.arange(len(x)), _assign(x, c)] = 1
                total[first:first + len(c)] += own.T @ wide
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    rows = vec.select("features").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(firsts[-1] * (d + 2))
    for r in rows:
        total[r["at"]] = r["v"]
    total = total.reshape(-1, d + 2)
    for s, a, b in zip(sets, firsts[:-1], firsts[1:]):
        s.counts, s.norms, s.sums = total[a:b, 0], total[a:b, 1], total[a:b, 2:]


def _lloyd(vec: DataFrame, sets: list[CentreSet], d: int, max_iter: int, tol: float) -> None:
    moving, spread = sets, None
    for _ in range(max_iter):
        _step(vec, moving, d)
        if spread is None:  # mean variance of the columns: the scale of the tolerance
            s = moving[0]
            n = s.counts.sum()
            spread = max((s.norms.sum() / n - ((s.sums.sum(0) / n) ** 2).sum()) / d, 0.0)
        still = []
        for s in moving:
            new = np.where(s.counts[:, None] > 0, s.sums / np.maximum(s.counts, 1)[:, None], s.centres)
            shift, s.centres = ((new - s.centres) ** 2).sum(), new
            if shift > tol * spread:
                still.append(s)
        moving = still
        if not moving:
            break
    _step(vec, sets, d)


def _silhouettes(vec: DataFrame, sets: list[CentreSet], d: int) -> list[float | None]:
    """Mean squared-Euclidean silhouette of each set, from its clusters' sums; None below two clusters."""
    tables = [(s.centres, s.counts, s.sums, s.norms) for s in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tables))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            sq = (x * x).sum(1, keepdims=True)
            for j, (c, n, sums, q) in enumerate(tables):
                some = np.flatnonzero(n > 0)
                if len(some) < 2:
                    continue
                mean = sq - 2 * (x @ (sums[some] / n[some, None]).T) + q[some] / n[some]
                own = np.searchsorted(some, _assign(x, c))
                rows = np.arange(len(x))
                mine, size = mean[rows, own], n[some][own]
                mean[rows, own] = np.inf
                a, b = mine * size / np.maximum(size - 1, 1), mean.min(1)
                top = np.maximum(a, b)
                total[j] += np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    rows = vec.select("features").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    found = {r["at"]: r["v"] for r in rows}
    return [float(found[j] / s.counts.sum()) if (s.counts > 0).sum() >= 2 else None for j, s in enumerate(sets)]


def kmeans(df: DataFrame, cols: list[str], k: int | None = None, key: str = "row_id", min_k: int = 2,
           max_k: int = 10, n_init: int = 10, seed: int = 42, max_iter: int = 300, rescale: bool = True,
           tol: float = 1e-4):
    """Returns (labels frame (key, cols…, cluster), k, search rows (k, silhouette, cost, error), cost)."""
    ship(df.sparkSession)
    data = standardize(df, cols, keep=[key]) if rescale else df.select(key, *cols)
    vec = data.withColumn("features", F.array(*[qcol(c).cast("double") for c in cols])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, d = vec.count(), len(cols)
        few = vec.coalesce(max(1, -(-n // ROWS_PER_TASK)))
        ks = [k] if k is not None else list(range(min_k, max_k + 1))
        fitting = [kk for kk in ks if kk <= n]
        if not fitting:
            raise ValueError(f"k-means failed: {n} rows for k={ks[0]}")
        sets = _starts(few, key, fitting, n_init, seed, d)
        _lloyd(few, sets, d, max_iter, tol)
        best = {kk: min((s for s in sets if s.k == kk), key=lambda s: (s.cost, s.restart)) for kk in fitting}
        search = []
        if k is None:
            scores = dict(zip(fitting, _silhouettes(few, [best[kk] for kk in fitting], d)))
            search = [(kk, scores[kk], best[kk].cost, None) if kk in best else (kk, None, None, f"{n} rows for k={kk}")
                      for kk in ks]
            ranked = sorted((-s, kk) for kk, s in scores.items() if s is not None)
            k = ranked[0][1] if ranked else fitting[0]
        centres = best[k].centres

        @F.pandas_udf("int")
        def nearest(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype="int32")
            return pd.Series(_assign(np.stack(features.to_numpy()), centres).astype(np.int32))

        labels = vec.select(key, *cols, nearest("features").alias("cluster"))
        return labels, k, search, best[k].cost
    finally:
        vec.unpersist()
