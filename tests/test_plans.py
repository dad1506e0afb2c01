"""Physical-plan properties the scale design relies on."""

import pytest

from tabsight.operators import profile as P
from tabsight.plans.catalog import QUERIES
from tabsight.sources.tables import read_table

from .conftest import SF_SMALL

KEYS = ["screen_columns", "overview_metrics", "correlation_matrix", "category_distribution", "dbscan_labels",
        "knn_distance", "inertia", "davies_bouldin", "cv_folds", "holdout_split", "findings_clustering", "one_hot"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_or_nested_loop_join(spark, key):
    plan = _plan(QUERIES[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_topk_is_limited_map_side_and_scan_is_pruned(spark):
    orders = read_table(spark, SF_SMALL, "orders")
    top = P.top_values(P.frequency_table(orders, ["o_orderpriority"]), 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "o_orderpriority" in scan and "o_totalprice" not in scan
