"""Registered queries against their SQL twins on the smallest tables, and the driver's entry points."""

import pytest

import __spark_entry__ as entry
from tests.parity import compare
from tideline.plans import catalogue

SF = "/root/testdata/sf0.001"
CHECKED = (
    "location_summary location_by_group weighted_quantile mode_weighted trimmed_mean winsorized_mean weighted_std median_abs_dev gini_coefficient hodges_lehmann histogram_30 "
    "spearman_matrix kendall_pair xi_pair somers_d autocorrelation_matrix frequency_inference fill_linear fill_mean_limit rolling_std rolling_time_window kalman_smooth ewm_std ewm_corr "
    "rolling_rank_pair rolling_corr_spearman association_summary autocorrelation_summary as_of_backward backtest_learner backtest_monthly newton_step fkm sign_linear exp3_median ucb fixed_share "
    "time_fixed_share kmeans_weighted kmeans_iw_v1 kharmonic rolling_autocorr backtest_steps_calendar backtest_targets backtest_persistence hedge_weights time_hedge adam kmeans_weighted_step kmeans_assign"
).split()


@pytest.mark.parametrize("name", CHECKED)
def test_parity(spark, name):
    assert compare(catalogue.QUERIES[name](spark, SF), SF, catalogue.ORACLES[name]) == ""


def test_entry_points(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
