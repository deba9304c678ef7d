"""Plan properties of every registered library query: no row-at-a-time Python,
Arrow batches only where TreeSHAP runs or whole-size ensembles score, pruned
scans, pushed filters."""

import pytest

import __spark_entry__ as entry
from loanlens.plans import registry

SF = "/root/testdata/sf0.001"
TRAINING = {"score_book", "tree_shap_model", "model_search", "best_trial"}
SHAP = {"tree_shap", "shap_base_value", "top_factors", "chart_factors", "pack_factors", "factor_display_names",
        "history_page", "parse_risk_factors", "tree_shap_deep"}
ARRAYS = {"score_tree_arrays"}  # 500 trees as flat arrays, a batch of rows at a time


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.all_queries()) - TRAINING))
def test_no_row_at_a_time_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    assert "BatchEvalPython" not in plan
    assert name in ARRAYS or "ArrowEvalPython" not in plan
    if name not in SHAP:
        assert "MapInPandas" not in plan


def test_scans_are_pruned_and_filtered(spark):
    text = entry.queries()["feature_bureau"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # lineitem is read with the 8 columns the bureau derivation uses, not all 11,
    # and the orders filter reaches the scan
    assert "lineitem" in text and "l_shipdate" not in text and "l_partkey" not in text
    assert "PushedFilters" in text
    full = entry.queries()["feature_previous"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in full and "o_orderdate" not in full
