"""Neighbour joins through the ball tree against brute force, in few and many dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import dbscan as DB
from tabsight.operators import metric_index as MX
from tabsight.operators import neighbors as NB

from tests.test_invariants import _brute_dbscan

SCHEMA = "row_id long, features array<double>"


def make(kind, dims, n=420):
    rng = np.random.default_rng(dims)
    if kind == "clusters":
        centres = rng.normal(0, 6, (9, dims))
        return centres[rng.integers(0, 9, n)] + rng.normal(0, 0.3, (n, dims))
    if kind == "one-hot":
        x = np.zeros((n, dims))
        x[np.arange(n), rng.integers(0, dims - 2, n)] = 4.0
        x[:, -2:] = rng.integers(0, 12, (n, 2)) / 4
        return x
    if kind == "hot spot":  # a third of the rows at one point, the rest spread
        x = rng.normal(0, 1, (n, dims))
        x[: n // 3] = x[0]
        return x
    return rng.normal(0, 1, (n, dims))


def brute_kth(x, k):
    return np.sort(np.sqrt(MX.squared(x, x)), axis=1)[:, k - 1]


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], SCHEMA)


@pytest.mark.parametrize("kind, dims", [("clusters", 3), ("one-hot", 27), ("hot spot", 5), ("spread", 64), ("clusters", 64)])
def test_distances_and_clusters_equal_brute_force(spark, kind, dims):
    x = make(kind, dims)
    ids = np.arange(len(x)) * 7 + 3
    points = frame(spark, x, ids)
    tree = MX.build(points, cell=24)
    assert tree.leaves.agg(F.max(F.size("names"))).first()[0] <= 24
    k = 6
    want = brute_kth(x, k)
    got = {r["row_id"]: r["kdist"] for r in MX.kth_distance(tree, k).collect()}
    assert np.allclose([got[int(i)] for i in ids], want)
    for eps in (float(np.quantile(want, 0.5)), float(np.quantile(want, 0.9))):
        rows = {r["row_id"]: r["cluster"] for r in DB.dbscan(points, eps, k, tree).collect()}
        assert rows == _brute_dbscan(x, ids, eps, k)
        counts = {r["name"]: r["n"] for r in MX.Join.within(tree, eps).counts().collect()}
        whole = dict(zip(ids.tolist(), MX.close(x, x, eps).sum(1).tolist(), strict=True))
        assert counts == {name: whole[name] for name in counts}


def test_work_is_far_below_all_pairs(spark):
    x = make("one-hot", 27, 1_500) + np.random.default_rng(1).normal(0, 0.01, (1_500, 27))
    tree = MX.build(frame(spark, x, range(1_500)), cell=32)
    assert MX.Join.within(tree, 0.5).compared() < 0.2 * 1_500 ** 2


def test_names_may_be_texts_and_order_of_rows_does_not_matter(spark):
    x = make("clusters", 4, 200)
    rows = [(f"r{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)]
    found = []
    for n in (1, 9):
        df = spark.createDataFrame(rows, "row_id string, features array<double>").repartition(n)
        tree = MX.build(df, cell=20)
        found.append((sorted(map(tuple, DB.dbscan(df, 0.9, 5, tree).collect())), sorted(map(tuple, MX.kth_distance(tree, 4).collect()))))
    assert found[0] == found[1]
    labels = {r[0]: r[1] for r in found[0][0]}
    want = _brute_dbscan(x, np.arange(200), 0.9, 5)
    assert labels == {f"r{i:03d}": c for i, c in want.items()}


def test_small_and_equal_tables(spark):
    assert MX.build(spark.createDataFrame([], SCHEMA)) is None
    one = frame(spark, np.zeros((1, 3)), [5])
    assert [tuple(r) for r in NB.kth_neighbor_distance(one, 4).collect()] == [(5, 0.0)]
    same = frame(spark, np.array([[0.0, -0.0, 1.0]] * 40 + [[0.0, 0.0, 1.0]] * 40), range(80))
    assert {(r["cluster"], r["is_core"]) for r in DB.dbscan(same, 0.1, 80).collect()} == {(0, True)}
    assert {r["kdist"] for r in NB.kth_neighbor_distance(same, 50).collect()} == {0.0}
    two = frame(spark, np.array([[0.0, 0, 0], [3.0, 4.0, 0]]), [1, 2])
    assert {r["kdist"] for r in NB.kth_neighbor_distance(two, 9).collect()} == {5.0}


def test_leaves_are_copied_once_a_band_and_not_once_a_pair(spark):
    x = make("spread", 64, 700)
    tree = MX.build(frame(spark, x, range(700)), cell=8)
    join = MX.Join.within(tree, 20.0)  # balls rule nothing out
    leaves, pairs = tree.leaves.count(), join.pairs.count()
    assert pairs == leaves ** 2
    assert MX._dealt(tree, join.pairs, tree.leaves, tree.leaves).count() == 2 * MX.BANDS * leaves < pairs / 4
    assert join.pairs.columns == ["a", "b"]


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (0.25, 1e7), (1e200, 0.0), (1e-200, 0.0)])
def test_products_decide_like_the_distance_itself(scale, shift):
    x = np.random.default_rng(3).integers(-4, 5, (200, 12)) * scale + shift
    whole = np.sqrt(MX.squared(x, x[:90]))
    for r in np.quantile(whole, [0.0, 0.01, 0.3, 0.9]):  # distances that points really have
        assert (MX.close(x, x[:90], float(r)) == (whole <= r)).all()


def test_eps_runs_the_neighbour_join_once(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(90, 5))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    rows, join = spark.sparkContext.accumulator(0), MX.kth_distance

    def counted(tree, k):
        def run(batches):
            for b in batches:
                rows.add(b.num_rows)
                yield b

        return join(tree, k).mapInArrow(run, "row_id long, kdist double")

    monkeypatch.setattr(MX, "kth_distance", counted)
    eps, _ = NB.estimate_eps(points, 4)
    assert rows.value == len(x)
    assert eps == pytest.approx(np.percentile(np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 3], 90))
