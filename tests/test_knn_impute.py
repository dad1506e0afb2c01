"""KNN imputation against nan-Euclidean brute force."""

import numpy as np
import pytest

from tabsight.operators import metric_index as MX
from tabsight.operators.knn_impute import knn_impute
from tabsight.operators.prep import preprocess


def brute(x, ids, k):
    out = x.copy()
    n, c = x.shape
    have = ~np.isnan(x)
    for i in range(n):
        for j in np.flatnonzero(~have[i]):
            near = []
            for o in range(n):
                both = have[i] & have[o]
                if have[o, j] and both.any():
                    near.append((((x[i, both] - x[o, both]) ** 2).sum() * c / both.sum(), ids[o], x[o, j]))
            near.sort()
            got = [v for _, _, v in near[:k]]
            out[i, j] = np.mean(got) if got else np.nanmean(x[:, j]) if have[:, j].any() else np.nan
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "hot spot"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(MX, "CELL", 16)
    rng = np.random.default_rng(6)
    n, c = 260, 4
    x = rng.normal(0, 1, (n, c)) if kind == "spread" else rng.integers(0, 3, (n, c)).astype(float)
    if kind == "hot spot":
        x[: n // 3] = [1.0, 2.0, 0.0, 1.0]
        x[:, 3] += np.arange(n)
    x[rng.random((n, c)) < 0.15] = np.nan
    x[0], x[1, :3] = np.nan, np.nan  # a row with nothing at all
    ids = rng.permutation(n) * 3
    rows = [(int(i), "kept", *[None if np.isnan(v) else float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "row_id long, filled string, a double, b double, `c.d` double, e double").repartition(5)
    got = {r["row_id"]: [r[i] for i in range(2, 6)] for r in knn_impute(df, ["a", "b", "c.d", "e"], k=5).collect()}
    want = brute(x, ids, 5)
    assert np.allclose([got[int(i)] for i in ids], want)


def test_equal_rows_ask_once_and_give_k_times(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.tile(np.where(rng.random((30, 3)) < 0.25, np.nan, rng.integers(0, 9, (30, 3)).astype(float)), (20, 1))
    x[np.isnan(x[:, 0]), 1] *= -0.0  # 0.0 and -0.0 are equal
    ids = rng.permutation(len(x))
    rows = [(int(i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double").repartition(6)
    seen, nearest = [], MX.nearest

    def spy(tree, queries, k, values):
        seen.append((queries.groupBy("qid").count().count(), values.groupBy("row_id").count().count()))
        return nearest(tree, queries, k, values)

    monkeypatch.setattr(MX, "nearest", spy)
    got = {r["row_id"]: [r["a"], r["b"], r["c"]] for r in knn_impute(df, ["a", "b", "c"], k=3).collect()}
    want = brute(x, ids, 3)
    assert np.allclose([got[int(i)] for i in ids], want)
    assert seen[0][0] <= 30 and seen[0][1] <= 90
    seen.clear()
    twice = knn_impute(df.union(df.limit(1)), ["a", "b", "c"], k=3)  # an id that names two rows: each for itself
    assert twice.count() == 601 and seen[0][0] > 30


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 4.0, None)], "row_id long, a double, b double")
    assert sorted(tuple(r) for r in knn_impute(df, ["a", "b"]).collect()) == [(1, 1.0, None), (2, 2.5, None), (3, 4.0, None)]
    assert knn_impute(df.limit(0), ["a", "b"]).count() == 0
    full = spark.createDataFrame([(1, 1, 2.0)], "row_id long, a int, b double")
    assert [tuple(r) for r in knn_impute(full, ["a", "b"]).collect()] == [(1, 1.0, 2.0)]


def test_preprocessing_with_neighbours(spark):
    rows = [(float(i), float(i) * 2 if i % 4 else None, "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "size double, price double, kind string")
    done = preprocess(df, use_knn=True)
    got = sorted((r["size"], r["price"]) for r in done.frame.collect())
    prices = np.array([p for _, p in got])
    assert len(got) == 60 and abs(prices.mean()) < 1e-9 and np.corrcoef([s for s, _ in got], prices)[0, 1] > 0.99
    assert done.preprocessor.summary()["use_knn_imputer"] is True
