"""Registered queries against their SQL on the smallest tables, and plan checks."""

import re

import pytest
from harness import compare

from __spark_entry__ import entry, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
Q, O = queries(), oracle_sql()
KEYS = (
    "bars_build ca_adj_close cal_trading_days feat_returns feat_52w feat_beta ind_macd ind_adx macro_returns fund_sector_median asof_sector_fallback cs_rank cs_sector_rank "
    "dq_tiers regime_labels merge_upsert json_infer_year html_table_long html_list_items sig_final sig_calibrate port_sizes risk_decision bt_nav perf_metrics ml_folds "
    "ml_winsorize led_realise rpt_capital_waterfall ml_fold_prep ml_walk_forward_coverage ml_ffill_bfill dq_ml_checks bt_param_grid ml_score_panel "
    "sink_replace src_coerced src_bare_ticker regime_of_day risk_rejected led_committed led_seed cs_norm_overall eval_ic_decay sig_tier_shrink"
).split()


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, key):
    assert compare(spark, duck, SMALL, Q[key], O[key]) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["tk", "d"] and df.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["cs_rank", "asof_fundamentals", "sig_calibrate", "ml_fold_counts", "ml_winsorize", "bt_param_grid", "cs_norm_apply"])
def test_no_nested_loops(spark, key):
    text = plan(Q[key](spark, SMALL))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_scan_is_pruned_and_filtered(spark):
    text = plan(Q["scan_project_filter"](spark, SMALL))
    assert "PushedFilters: [" in text and "EqualTo(l_returnflag,R)" in text and "l_tax" not in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(Q["bt_topk_fallback"](spark, SMALL))


@pytest.mark.parametrize("key", ["ca_adj_close", "ca_cum_factor", "ml_ffill_bfill", "feat_52w"])
def test_no_frame_looks_ahead_without_bound(spark, key):
    """Such a frame is read again from every row; whole-partition frames (unbounded on both sides) are fine."""
    assert not re.search(r"RowFrame, (?!unboundedpreceding)[^,]+, unboundedfollowing", plan(Q[key](spark, SMALL)))
