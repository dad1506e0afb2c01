"""Centroid clustering against a plain version with Python integers, and the bounds against true distances."""

import hashlib
import math

import numpy as np
import pytest

from tabsight.llm import simplex_clusters as sc

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def plain(rows, k, rounds, dimensions, scale=sc.SCALE, seed=sc.SEED):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), i, q) for i, q in kept if i is not None)
    centres = [q for _, _, q in starts[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centres)) for _, q in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            held = [q for (_, q), (_, c) in zip(kept, found, strict=True) if c == n]
            if held:
                centres[n] = [sum(col) // len(held) for col in zip(*held, strict=True)]
    return sorted(((-1 if i is None else i), c, d) for (i, _), (d, c) in zip(kept, assign(), strict=True)), centres


def got(done):
    return sorted((-1 if r["id"] is None else r["id"], r["cluster"], r["distance"]) for r in done.rows.collect())


@pytest.mark.parametrize("kind", ["spread", "line", "equal", "lumps"])
def test_equals_plain_version(spark, kind):
    rng = np.random.default_rng(5)
    make = {"spread": lambda: rng.normal(0, 1, 6), "line": lambda: np.arange(6.0) * rng.integers(-9, 9),
            "equal": lambda: np.ones(6), "lumps": lambda: rng.integers(-3, 4, 6) + rng.normal(0, 0.01, 6)}[kind]
    rows = [(int(i), [float(x) for x in np.float32(make())]) for i in rng.integers(0, 200, 300)]
    want, centres = plain(rows, 12, 4, 6)
    for parts in (1, 7):  # repeated ids and any partitioning
        done = sc.cluster(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(parts), k=12, rounds=4, dimensions=6)
        assert got(done) == want
        assert done.centres.tolist() == centres


def test_odd_rows(spark):
    fine = [1.0, -0.5]
    rows = [(1, fine), (None, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]),
            (6, [float("inf"), 0.0]), (1, fine), (7, [3.0, 3.0]), (8, [])]
    df = spark.createDataFrame([(i, v, "clash", 9) for i, v in rows], SCHEMA)
    want, _ = plain(rows, 40, 5, 2)
    done = sc.cluster(df, dimensions=2)
    assert got(done) == want and len(want) == 4
    table = sc.digests(done).collect()
    assert {r["inertia"] for r in table} == {sum(d for _, _, d in want)}
    assert {r["centroid_sha256"] for r in table if r["vec_id"] == 7} == {hashlib.sha256(b"768,768").hexdigest()}
    empty = sc.digests(sc.cluster(df.limit(0), dimensions=2))
    assert empty.count() == 0 and empty.columns == sc.digests(done).columns
    only_null = sc.cluster(df.where("vec_id IS NULL"), dimensions=2)
    assert got(only_null) == [(-1, 0, 0)]


def test_floors_of_negative_components(spark):
    rows = [(i, [x]) for i, x in enumerate([-0.001, -0.004, -1.0, 0.003, 0.999])]
    want, centres = plain(rows, 2, 3, 1)
    done = sc.cluster(spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA), k=2, rounds=3, dimensions=1)
    assert got(done) == want and done.centres.tolist() == centres


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9], "", 0)], SCHEMA)
    with pytest.raises(ValueError, match="beyond"):
        sc.cluster(df, dimensions=1)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (30, 20))
    near = centres[rng.integers(0, 30, 500)] + rng.integers(-40, 40, (500, 20))
    simplex = sc.Simplex.over(centres, 12)
    assert len(simplex.pivots) == 12
    low, high, reach = sc.bounds(simplex.apexes(near), simplex.apexes(centres))
    true = np.sqrt(sc.squared(near, centres))
    assert (low <= true + reach[:, None]).all() and (true <= high + reach[:, None]).all()
    found, distance, compared = sc.nearest(near, simplex.apexes(near), centres, simplex.apexes(centres))
    assert (found == sc.squared(near, centres).argmin(1)).all() and (distance == sc.squared(near, centres).min(1)).all()
    assert compared < 2 * len(near)  # of 30 each: the filter leaves hardly any besides the nearest
