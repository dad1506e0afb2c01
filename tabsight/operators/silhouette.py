"""The Euclidean silhouette of a clustering, between proven bounds.

A row's silhouette needs the sum of its distances to every cluster. The rows of a cell of the ball tree
(``metric_index``) that belong to one cluster stand for their sum by number, mean and mean square distance to the
mean: for n of them, with mean m and spread v, n·|p−m| ≤ Σ|p−q| ≤ n·√(|p−m|² + v), as the norm is convex and the root concave.
Leaves descend through the tree as in a neighbour join: a cell whose radius is small beside its distance is
taken by its bounds, others are opened, and leaves that stay too near are summed row by row. Sums between bounds give
every row's silhouette, and so the mean, an interval that holds the true value. Until it is as narrow as asked for, the
descent is repeated with cells at half the angle.

As elsewhere here, noise (-1) is one more cluster, and a row alone in its cluster has silhouette 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metric_index as MX

WIDTH, ANGLE, ROUNDS = 0.02, 0.5, 8


@dataclass
class Interval:
    """Bounds of the mean silhouette, and how many distances of point pairs and of points to cells they took."""

    low: float
    high: float
    exact_pairs: int
    cell_pairs: int

    def settles(self, cut: float) -> bool:
        """Whether the true value is surely on one side of ``cut``."""
        return self.low > cut or self.high <= cut


def _visits(tree: MX.Tree, angle: float) -> DataFrame:
    """(``a``, ``b``, ``far``): for each leaf the cells that cover all points once; ``far`` ones are seen at
    less than ``angle``, the others are leaves."""
    dims = tree.dims

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap = np.sqrt(((MX._matrix(b.column("ca").to_pylist(), dims) - MX._matrix(b.column("cb").to_pylist(), dims)) ** 2).sum(1))
            far = b.column("rb").to_numpy() <= angle * (gap - b.column("ra").to_numpy())
            yield pa.record_batch([*(b.column(c) for c in ("a", "ca", "ra", "b", "leaf")), pa.array(far)], ["a", "ca", "ra", "b", "leaf", "far"])

    frontier = tree.nodes.where("leaf").select(F.col("cell").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"),
                                               F.substring_index("cell", ".", 1).alias("up"))
    below = tree.nodes.select(F.col("parent").alias("up"), F.col("cell").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"), "leaf")
    done = None
    while True:
        step = frontier.join(below, "up").select("a", "ca", "ra", "b", "cb", "rb", "leaf").mapInArrow(
            judge, "a string, ca binary, ra double, b string, leaf boolean, far boolean").checkpoint()
        ended = step.where("far OR leaf").select("a", "b", "far")
        done = ended if done is None else done.union(ended)
        frontier = step.where("NOT far AND NOT leaf").select("a", "ca", "ra", F.col("b").alias("up"))
        if frontier.isEmpty():
            return done


def _summaries(tree: MX.Tree, entries: DataFrame) -> DataFrame:
    """(``b``, ``cluster``, ``n``, ``mean``, ``spread``) for every cell of the tree and cluster in it."""
    dims = tree.dims
    # a leaf's entries count in all cells above it: the prefixes of its name
    steps = F.split("cell", r"\.")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "."))).alias("b")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, x = b.column("w").to_numpy().astype(float), MX._matrix(b.column("x").to_pylist(), dims)
            yield pa.record_batch([b.column("b"), b.column("cluster"), b.column("w"),
                                   pa.array((w[:, None] * x).tolist(), pa.list_(pa.float64())), b.column("x")], ["b", "cluster", "w", "sums", "x"])

    each = entries.select(above, "cluster", "w", "x")
    long = each.mapInArrow(sums, "b string, cluster long, w long, sums array<double>, x binary").select("b", "cluster", "w", F.posexplode("sums").alias("i", "s"))
    means = (long.groupBy("b", "cluster", "i").agg(F.sum("s").alias("s"), F.sum("w").alias("n"))
             .groupBy("b", "cluster").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("m")))).alias("m"))
             .select("b", "cluster", "n", F.col("m.m").alias("mean")).checkpoint())

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean = b.column("mean").flatten().to_numpy().reshape(b.num_rows, dims)
            d = ((MX._matrix(b.column("x").to_pylist(), dims) - mean) ** 2).sum(1) * b.column("w").to_numpy()
            yield pa.record_batch([b.column("b"), b.column("cluster"), pa.array(d)], ["b", "cluster", "d"])

    spread = (each.join(means, ["b", "cluster"]).select("b", "cluster", "w", "x", "mean")
              .mapInArrow(gaps, "b string, cluster long, d double").groupBy("b", "cluster").agg(F.sum("d").alias("d")))
    return means.join(spread, ["b", "cluster"]).select("b", "cluster", "n", "mean", (F.col("d") / F.col("n")).alias("spread")).checkpoint()


def _bounds(tree: MX.Tree, entries: DataFrame, summaries: DataFrame, sizes: dict[int, int], angle: float) -> Interval:
    dims = tree.dims
    names = sorted(sizes)
    code = {c: i for i, c in enumerate(names)}
    total = np.array([sizes[c] for c in names], float)
    visits = _visits(tree, angle)
    packed = entries.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("x", "cluster", "w"))).alias("p")).select(
        "cell", F.col("p.x").alias("x"), F.col("p.cluster").alias("cluster"), F.col("p.w").alias("w")).checkpoint()
    # what leaf a is given: itself (kind 0), leaves to sum row by row (1), cells to bound (2)
    mean = F.lit(None).cast("array<double>")
    own = packed.select(F.col("cell").alias("a"), F.lit(0).alias("kind"), "x", "cluster", "w", mean.alias("mean"), F.lit(0.0).alias("spread"))
    near = visits.where("NOT far").join(packed, F.col("b") == F.col("cell")).select(
        "a", F.lit(1).alias("kind"), "x", "cluster", "w", mean.alias("mean"), F.lit(0.0).alias("spread"))
    far = visits.where("far").join(summaries, "b").select(
        "a", F.lit(2).alias("kind"), F.lit(None).cast("array<binary>").alias("x"), F.array("cluster").alias("cluster"),
        F.array("n").alias("w"), "mean", "spread")

    def run(key, table):
        kinds = table.column("kind").to_numpy()
        rows = table.to_pylist()
        me = rows[int(np.flatnonzero(kinds == 0)[0])]
        x = MX._matrix(me["x"], dims)
        low = np.zeros((len(x), len(names)))
        exact, cells = 0, 0
        for r in (rows[i] for i in np.flatnonzero(kinds == 1)):
            d = np.sqrt(MX.squared(x, MX._matrix(r["x"], dims))) * np.array(r["w"], float)
            np.add.at(low.T, [code[c] for c in r["cluster"]], d.T)
            exact += d.size
        high = low.copy()
        bounded = [rows[i] for i in np.flatnonzero(kinds == 2)]
        if bounded:
            n = np.array([r["w"][0] for r in bounded], float)
            sq = MX.squared(x, np.array([r["mean"] for r in bounded]))
            at = [code[r["cluster"][0]] for r in bounded]
            np.add.at(low.T, at, (n * np.sqrt(sq)).T)
            np.add.at(high.T, at, (n * np.sqrt(sq + np.array([r["spread"] for r in bounded]))).T)
            cells = sq.size
        mine = np.array([code[c] for c in me["cluster"]])
        w, k = np.array(me["w"], float), np.arange(len(x))
        alone = total[mine] < 2
        others = np.maximum(total[mine] - 1, 1)
        a_low, a_high = low[k, mine] / others, high[k, mine] / others
        low, high = low / total, high / total
        low[k, mine] = high[k, mine] = np.inf
        b_low, b_high = low.min(1), high.min(1)

        def silhouette(a, b):
            top = np.maximum(a, b)
            return np.where(alone | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top))

        return pa.table({"low": [float((w * silhouette(a_high, b_low)).sum())], "high": [float((w * silhouette(a_low, b_high)).sum())],
                         "w": [float(w.sum())], "exact": [int(exact)], "cells": [int(cells)]})

    parts = own.union(near).union(far).groupBy("a").applyInArrow(run, "low double, high double, w double, exact long, cells long")
    r = parts.agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("w").alias("w"), F.sum("exact").alias("exact"), F.sum("cells").alias("cells")).first()
    return Interval(r["low"] / r["w"], r["high"] / r["w"], r["exact"], r["cells"])


def silhouette(tree: MX.Tree, labels: DataFrame, width: float = WIDTH, angle: float = ANGLE, rounds: int = ROUNDS) -> Interval | None:
    """An interval of at most ``width`` for the mean silhouette of ``labels`` (``row_id``, ``cluster``; every row of the tree), or the
    narrowest of ``rounds`` rounds. None with fewer than two clusters. The cluster sizes, a row each, are held on the driver."""
    rows = tree.rows.join(labels.select("row_id", F.col("cluster").cast("long").alias("cluster")), "row_id")
    counted = rows.groupBy("name", "cluster").agg(F.count(F.lit(1)).alias("w"))
    entries = tree.points.select("cell", "name", "x").join(counted, "name").select("cell", "x", "cluster", "w").checkpoint()
    sizes = {r["cluster"]: r["n"] for r in entries.groupBy("cluster").agg(F.sum("w").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    summaries = _summaries(tree, entries)
    found = None
    for _ in range(rounds):
        found = _bounds(tree, entries, summaries, sizes, angle)
        if found.high - found.low <= width or not found.cell_pairs:
            break
        angle /= 2
    return found
