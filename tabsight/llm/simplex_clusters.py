"""Centroid clustering of integer vectors, with centroids filtered by n-simplex projection.

The kept vectors are made integers. A few pivots, taken from the starting centroids, span a simplex.
A vector's distances to them, worked out once, give the coordinates of its apex over that simplex: one
coordinate a pivot, the last being the altitude. For two vectors the Euclidean distance of their apexes
is at most their own, and with one altitude turned over it is at least their own. Each pass so knows, for
every vector and centroid, a lower and an upper bound; only centroids whose lower bound does not exceed
the smallest upper bound (and a margin far above rounding) stay open. Of these the one with the least lower
bound is compared exactly, in 64-bit integers, and then those whose lower bound is within that distance.

Spark holds the vectors as rows of packed integers and apex coordinates, written once. A pass sums
rows and components per centroid inside the tasks and then over them, as decimals; the driver sees only
``k`` x ``dimensions`` sums. Every centroid's new components are exact floors of sum / count; ties go to the
smaller number; a centroid without vectors stays as it is. No result depends on the partitioning.

Defined results: a vector that is null, of another length, or with a null or non-finite component is
left out. With fewer than ``k`` kept vectors there are as many centroids. Rows that repeat are rows; a repeated
id starts a centroid by the order of its vectors. A row with a null id is clustered, but starts no
centroid. Without kept rows the result is empty. Columns other than the id and the vector are not read, so their
names cannot clash. A component beyond ``LIMIT`` after scaling is an error, as distances would not fit in a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import ship, stored

K, ROUNDS, SCALE, DIMENSIONS, SEED = 40, 5, 256, 64, 2
PIVOTS, LEAST_ALTITUDE = 24, 0.2  # a pivot's altitude over those before it, as a share of the widest distance
LIMIT, MARGIN, ROWS = 1 << 26, 1e-6, 1_024


@dataclass
class Simplex:
    """Pivots and their own apexes: row j of ``base`` holds the j coordinates of pivot j + 1."""

    pivots: np.ndarray  # P x d integers
    base: np.ndarray  # (P - 1) x (P - 1), lower triangular

    @classmethod
    def over(cls, candidates: np.ndarray, most: int = PIVOTS) -> Simplex:
        """The first candidate, then always the one that stands highest over those chosen, while its altitude
        is large enough to keep the coordinates well conditioned."""
        chosen = cls(candidates[:1], np.zeros((0, 0)))
        widest = np.sqrt(squared(candidates, candidates[:1]).max())
        while len(chosen.pivots) < most:
            apexes = chosen.apexes(candidates)
            best = int(apexes[:, -1].argmax())
            if widest == 0 or apexes[best, -1] < LEAST_ALTITUDE * widest:
                break
            size = len(chosen.base)
            base = np.zeros((size + 1, size + 1))
            base[:size, :size] = chosen.base
            base[size] = apexes[best]
            chosen = cls(np.vstack([chosen.pivots, candidates[best]]), base)
        return chosen

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """Coordinates from the distances to the pivots: one row a vector, the altitude last."""
        far = squared(vectors, self.pivots).astype(float)
        found = np.zeros((len(vectors), len(self.pivots)))
        for j, row in enumerate(self.base):
            known = found[:, :j] @ row[:j]
            found[:, j] = ((far[:, 0] + row @ row - far[:, j + 1]) / 2 - known) / row[j]
        rest = far[:, 0] - (found[:, :-1] ** 2).sum(1)
        found[:, -1] = np.sqrt(np.maximum(rest, 0))
        return found


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of ``a`` by rows of ``b``."""
    return np.stack([((a - one) ** 2).sum(1) for one in b], axis=1)


def bounds(apexes: np.ndarray, centre_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances, vectors by centroids, and each vector's margin."""
    head = np.zeros((len(apexes), len(centre_apexes)))
    for j in range(apexes.shape[1] - 1):
        head += (apexes[:, j, None] - centre_apexes[None, :, j]) ** 2
    here, there = apexes[:, -1, None], centre_apexes[None, :, -1]
    reach = MARGIN * (np.sqrt((apexes ** 2).sum(1)) + np.sqrt((centre_apexes ** 2).sum(1).max()))
    return np.sqrt(head + (here - there) ** 2), np.sqrt(head + (here + there) ** 2), reach


def nearest(vectors: np.ndarray, apexes: np.ndarray, centres: np.ndarray, centre_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector its centroid, the squared distance, and how many exact comparisons that took in all."""
    low, high, reach = bounds(apexes, centre_apexes)
    likely = low.argmin(1)
    there = np.sqrt(((vectors - centres[likely]) ** 2).sum(1))
    left = low <= (np.minimum(there, high.min(1)) + reach)[:, None]
    distance = np.full(left.shape, np.iinfo(np.int64).max)
    for c in range(len(centres)):
        rows = np.flatnonzero(left[:, c])
        distance[rows, c] = ((vectors[rows] - centres[c]) ** 2).sum(1)
    found = distance.argmin(1)  # the first of equals
    return found, distance[np.arange(len(found)), found], int(left.sum())


def integers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS,
             scale: int = SCALE) -> DataFrame:
    """``id`` and ``q``, the floors of ``scale`` times the components, of the vectors that are kept."""
    v = F.col(vector).cast("array<double>")
    whole = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector).isNotNull()).where(whole).select(
        F.col(id_column).alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("q"))


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Packed rows of equal width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _pack(simplex: Simplex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                q = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, -1)
                if np.abs(q).max(initial=0) > LIMIT:
                    raise ValueError(f"a component of a vector is beyond {LIMIT} after scaling")
                apexes = simplex.apexes(q)
                yield pa.record_batch([batch.column("id"), pa.array([x.tobytes() for x in q.astype(np.int32)], pa.binary()),
                                       pa.array([x.tobytes() for x in apexes], pa.binary())], ["id", "q", "apex"])
    return run


def _parts(batches: Iterator[pa.RecordBatch], simplex: Simplex, centres: np.ndarray) -> Iterator[tuple]:
    """Of each piece of the rows: the ids, integers, centroids and distances."""
    centre_apexes = simplex.apexes(centres)
    for whole in batches:
        for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            q = _matrix(batch.column("q"), np.int32, centres.shape[1]).astype(np.int64)
            apexes = _matrix(batch.column("apex"), np.float64, len(simplex.pivots))
            found, distance, exact = nearest(q, apexes, centres, centre_apexes)
            yield batch.column("id"), q, found, distance, exact


def _totals(simplex: Simplex, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centres.shape
        sums, n, exact = np.zeros((k, d), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for _, q, found, _, compared in _parts(batches, simplex, centres):
            np.add.at(sums, found, q)
            n += np.bincount(found, minlength=k)
            exact[0] += compared
        held = np.flatnonzero(n)
        yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(n[held]), pa.array(exact[held]),
                               pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "exact", "sums"])
    return run


def _labels(simplex: Simplex, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found, distance, _ in _parts(batches, simplex, centres):
            yield pa.record_batch([ids, pa.array(found.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])
    return run


@dataclass
class Clustering:
    rows: DataFrame  # id, cluster, distance
    centres: np.ndarray
    compared: list[float]  # exact comparisons of each round, as a share of all pairs


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", *, k: int = K, rounds: int = ROUNDS,
            dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS) -> Clustering:
    """Assign every kept vector to a centroid after ``rounds`` rounds."""
    spark = vectors.sparkSession
    ship(spark)
    kept = integers(vectors, id_column, vector, dimensions, scale)
    id_type = kept.schema["id"].dataType.simpleString()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.where("id IS NOT NULL").orderBy(order, "id", "q").select("q").limit(k).collect()  # k rows
    if not first:
        first = kept.orderBy("q").select("q").limit(1).collect()
    if not first:
        empty = spark.createDataFrame([], f"id {id_type}, cluster int, distance long")
        return Clustering(empty, np.zeros((0, dimensions), np.int64), [])
    centres = np.array([r["q"] for r in first], np.int64)
    if np.abs(centres).max() > LIMIT:
        raise ValueError(f"a component of a vector is beyond {LIMIT} after scaling")
    simplex = Simplex.over(centres, pivots)
    points = stored(kept.mapInArrow(_pack(simplex), f"id {id_type}, q binary, apex binary"), "simplex-points")
    compared = []
    for _ in range(rounds):
        per_task = points.mapInArrow(_totals(simplex, centres), "cluster int, n long, exact long, sums array<long>")
        per_cell = per_task.select("cluster", "n", "exact", F.posexplode("sums").alias("i", "part"))
        totals = per_cell.groupBy("cluster", "i").agg(
            F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"), F.sum("exact").alias("exact")).collect()
        moved = centres.copy()
        for r in totals:  # k x dimensions
            moved[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
        rows = sum(r["n"] for r in totals if r["i"] == 0)
        compared.append(sum(r["exact"] for r in totals if r["i"] == 0) / max(1, rows * len(centres)))
        centres = moved
    last = stored(points.mapInArrow(_labels(simplex, centres), f"id {id_type}, cluster int, distance long"), "simplex-labels")
    return Clustering(last, centres, compared)


def digests(done: Clustering, id_column: str = "vec_id") -> DataFrame:
    """Every row with its centroid's inertia and digest. The joined table has one row a centroid."""
    spark = done.rows.sparkSession
    sums = done.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    whole = sum(int(r["s"]) for r in sums)
    facts = [(r["cluster"], int(r["s"]), whole,
              hashlib.sha256(",".join(map(str, done.centres[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.rows.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL of the digests, by all distances."""
    gaps = f"list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT"
    parts = [f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q
    FROM embeddings
    WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec_id, q) - 1 AS cluster, q AS c
    FROM kept WHERE vec_id IS NOT NULL QUALIFY cluster < {k})"""]
    for t in range(rounds + 1):
        parts.append(f"""
a{t} AS MATERIALIZED (
    SELECT r, min(row(d, cluster)) AS best FROM (SELECT r, cluster, {gaps} AS d FROM kept, c{t}) GROUP BY r)""")
        if t < rounds:
            parts.append(f"""
s{t} AS (
    SELECT cluster, i, sum(x)::HUGEINT AS s, count(*) AS n
    FROM (SELECT best[2] AS cluster, unnest(q) AS x, unnest(range(1, {dimensions + 1})) AS i FROM kept JOIN a{t} USING (r))
    GROUP BY cluster, i),
m{t} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{t} GROUP BY cluster),
c{t + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (cluster))""")
    return ",".join(parts) + f"""
SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance,
       (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.cluster = best[2]
"""
