"""Radix selection against numpy's linear quantiles."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tabsight.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    n = 5_003
    columns = {
        "spread": rng.normal(0, 1e6, n), "equal": np.full(n, -2.5), "few": rng.integers(-3, 4, n).astype(float),
        "tiny": rng.normal(0, 1, n) * 5e-324 * 1e6, "far": rng.choice([1e308, -1e308, 0.0, 1e-308], n),
        "ends": np.r_[np.full(n - 2, 1.0), [np.inf, -np.inf]], "near": 1.0 + rng.integers(0, 9, n) * 2.0 ** -52,
    }
    rows = [tuple(float(v[i]) for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(7)
    got = Q.exact_quantiles(df, list(columns), PROBS)
    for c, v in columns.items():
        at = np.array(PROBS) * (n - 1)
        ordered = np.sort(v)
        low, high = ordered[np.floor(at).astype(int)], ordered[np.ceil(at).astype(int)]
        with np.errstate(invalid="ignore"):
            want = np.where(low == high, low, low * (np.ceil(at) - at) + high * (at - np.floor(at)))
        assert np.allclose(got[c], want, rtol=1e-15, atol=0), c


def test_nulls_types_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None), (None, 2.0, None), (4, 7.0, None), (2, None, None)], "`a.b` int, x double, none double")
    got = Q.exact_quantiles(df, ["a.b", "x", "none"], [0.5, 0.75])
    assert got == {"a.b": [2.0, 3.0], "x": [4.5, 5.75], "none": [None, None]}
    assert Q.exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}
    assert Q.exact_quantiles(df, [], [0.5]) == {} and Q.exact_quantiles(df, ["x"], []) == {"x": []}


def test_columns_go_in_turns(spark, monkeypatch):
    df = spark.range(101).selectExpr("cast(id as double) a", "cast(-id as double) b", "cast(id * id as double) c")
    whole = Q.exact_quantiles(df, ["a", "b", "c"], [0.5, 0.9])
    monkeypatch.setattr(Q, "CELLS", 1)
    assert Q.exact_quantiles(df, ["a", "b", "c"], [0.5, 0.9]) == whole == {"a": [50.0, 90.0], "b": [-50.0, -10.0], "c": [2500.0, 8100.0]}


def test_no_percentile_in_the_plan():
    import inspect
    assert "percentile" not in inspect.getsource(Q)


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
@settings(max_examples=200, deadline=None)
def test_keys_sort_as_doubles(values):
    keys = Q.sortable(np.array(values))
    assert [Q.from_sortable(int(k)) for k in np.sort(keys)] == sorted(values)
    assert len({int(k) for k in Q.sortable(np.array([0.0, -0.0]))}) == 1


@pytest.mark.parametrize("value", [0.0, -1.5, float("inf"), -float("inf"), 5e-324])
def test_keys_turn_back(value):
    assert Q.from_sortable(int(Q.sortable(np.array([value]))[0])) == value
