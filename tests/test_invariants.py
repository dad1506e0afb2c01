"""Invariants of the seeded / iterative operators on the test tables (rows-only keys)."""

from pyspark.sql import functions as F

from tabsight.operators import dbscan as DB
from tabsight.operators import kmeans as KM
from tabsight.operators import model_eval as ME
from tabsight.operators import neighbors as NB
from tabsight.plans import derived as DV
from tabsight.plans.catalog import QUERIES
from tabsight.sources.tables import read_table

from .conftest import SF_CHECK, SF_SMALL


def _points(spark, sf=SF_CHECK):
    return DV.with_features(DV.part_points(read_table(spark, sf, "part")))


def test_dbscan_fixture_counts(spark):
    pts = _points(spark).cache()
    for eps, k, noise in [(0.12, 17, 126), (0.10, 71, 416)]:
        lab = DB.dbscan(pts, eps, 7)
        r = lab.agg(F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("k"),
                    F.count_if(F.col("cluster") == -1).alias("noise")).first()
        assert (r.k, r.noise) == (k, noise)
    eps, _ = NB.estimate_eps(pts, 7)
    assert round(eps, 6) == 0.13949


def test_knn_matches_brute_force(spark):
    import numpy as np
    pts = _points(spark, SF_SMALL)
    got = {r.row_id: r.kdist for r in NB.kth_neighbor_distance(pts, 5).collect()}
    arr = {r.row_id: np.array(r.features) for r in pts.collect()}
    ids = list(arr)
    X = np.stack([arr[i] for i in ids])
    d = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    kd = np.sort(d, axis=1)[:, 4]
    for i, v in zip(ids, kd):
        assert abs(got[i] - v) < 1e-12


def test_kmeans_invariants(spark):
    pts = DV.part_points(read_table(spark, SF_SMALL, "part"))
    lab, k, search, cost = KM.kmeans(pts, ["x0", "x1"], k=None, n_init=2, max_k=5)
    assert lab.count() == pts.count()
    assert lab.select("cluster").distinct().count() == k
    costs = [c for _, _, c, _ in search if c is not None]
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))  # inertia falls as k grows


def test_folds_partition_and_balance(spark):
    part = read_table(spark, SF_CHECK, "part").select("p_partkey", "p_type")
    f = ME.assign_folds(part, "p_partkey", "p_type", 5)
    assert f.count() == part.count() and f.select("p_partkey").distinct().count() == part.count()
    sizes = f.groupBy("p_type", "fold").count().groupBy("p_type").agg((F.max("count") - F.min("count")).alias("spread"))
    assert sizes.agg(F.max("spread")).first()[0] <= 1


def test_rank_within_hot_group(spark):
    # one group holds most rows: ranks must still be exact and dense inside it
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("g"),
                                     F.md5(F.col("id").cast("string")).alias("h"))
    r = ME.rank_within(df, "g", "h", partitions=7)
    chk = r.groupBy("g").agg(F.min("rank").alias("mn"), F.max("rank").alias("mx"), F.count(F.lit(1)).alias("n"),
                             F.count_distinct("rank").alias("nd")).collect()
    for row in chk:
        assert row.mn == 0 and row.mx == row.n - 1 and row.nd == row.n


def test_model_roundtrip_same_predictions(spark):
    rows = QUERIES["model_roundtrip"](spark, SF_SMALL).collect()
    assert rows and all(r.same for r in rows)


def test_entry_runs(spark):
    import __spark_entry__
    out = __spark_entry__.entry(spark)
    assert {"section", "severity", "message"} <= set(out.columns) and out.count() >= 5


def _brute_dbscan(X, ids, eps, ms):
    """Reference semantics in NumPy: clusters numbered by smallest core id, border → lowest cluster."""
    import numpy as np
    order = np.argsort(ids)
    X, ids = X[order], ids[order]
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    nb = D <= eps
    core = nb.sum(1) >= ms
    lab = -np.ones(len(X), dtype=int)
    c = 0
    for s in range(len(X)):
        if not core[s] or lab[s] != -1:
            continue
        stack = [s]
        lab[s] = c
        while stack:
            u = stack.pop()
            for v in np.nonzero(nb[u] & core)[0]:
                if lab[v] == -1:
                    lab[v] = c
                    stack.append(v)
        c += 1
    for u in range(len(X)):
        if not core[u]:
            cl = [lab[v] for v in np.nonzero(nb[u] & core)[0]]
            lab[u] = min(cl) if cl else -1
    return dict(zip(ids.tolist(), lab.tolist()))


def test_dbscan_hot_spot_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    pts = np.vstack([rng.normal(size=(300, 2)), np.tile([[0.3, -0.2]], (160, 1)), rng.normal(3, 0.3, size=(40, 2))])
    ids = np.arange(len(pts)) * 3 + 11
    df = spark.createDataFrame([(int(i), [float(a), float(b)]) for i, (a, b) in zip(ids, pts)], "row_id long, features array<double>")
    for eps in (0.15, 0.3):
        got = {r.row_id: r.cluster for r in DB.dbscan(df, eps, 6).collect()}
        assert got == _brute_dbscan(pts, ids, eps, 6)


def test_dbscan_embeddings_fixture(spark):
    # FIXTURES: 64-dimensional embeddings with automatic eps → one cluster, no noise
    rows = QUERIES["dbscan_embeddings"](spark, SF_CHECK).groupBy("cluster").count().collect()
    assert [(r.cluster, r["count"]) for r in rows] == [(0, 500)]
