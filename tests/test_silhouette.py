"""The silhouette's interval against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import metric_index as MX
from tabsight.operators import silhouette as SI


def brute(x, labels):
    d = np.sqrt(MX.squared(x, x))
    names = sorted(set(labels))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in names if c != labels[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def frames(spark, x, labels):
    rows = [(int(i), [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, cluster int")
    return df.select("row_id", "features"), df.select("row_id", "cluster")


@pytest.mark.parametrize("dims", [2, 8])
def test_interval_holds_the_true_value(spark, dims):
    rng = np.random.default_rng(dims)
    n = 700
    truth = rng.integers(0, 4, n)
    x = rng.normal(0, 8, (4, dims))[truth] + rng.normal(0, 1.0, (n, dims))
    x[:60] = x[0]  # equal rows, of different clusters too
    labels = np.where(rng.random(n) < 0.1, -1, truth)
    labels[-1] = 77  # alone
    points, clusters = frames(spark, x, labels)
    tree = MX.build(points, cell=24)
    want = brute(x, labels)
    wide, narrow = (SI.silhouette(tree, clusters, w) for w in (0.2, 0.01))
    for found in (wide, narrow):
        assert found.low - 1e-9 <= want <= found.high + 1e-9
    assert wide.high - wide.low <= 0.2 and narrow.high - narrow.low <= 0.01
    assert wide.exact_pairs <= narrow.exact_pairs <= n * n
    exact = SI.silhouette(tree, clusters, 0.0, angle=0.0)
    assert exact.low == pytest.approx(want, abs=1e-9) and exact.high == pytest.approx(want, abs=1e-9)


def test_work_is_far_below_all_pairs(spark):
    rng = np.random.default_rng(1)
    n = 3_000
    truth = rng.integers(0, 30, n)
    x = rng.normal(0, 30, (30, 3))[truth] + rng.normal(0, 1.0, (n, 3))
    points, clusters = frames(spark, x, truth)
    found = SI.silhouette(MX.build(points, cell=32), clusters, 0.05)
    assert found.low - 1e-9 <= brute(x, truth) <= found.high + 1e-9
    assert found.high - found.low <= 0.05 and found.exact_pairs + found.cell_pairs < 0.35 * n * n


def test_one_cluster_has_no_silhouette(spark):
    points, clusters = frames(spark, np.eye(4), np.zeros(4, int))
    assert SI.silhouette(MX.build(points), clusters) is None
    two = clusters.withColumn("cluster", F.col("row_id") % 2)
    found = SI.silhouette(MX.build(points), two)
    assert found.low == found.high == pytest.approx(0.0)
    assert found.settles(0.2) and not SI.Interval(0.1, 0.3, 0, 0).settles(0.2)
