"""Physical plans: no pairwise joins, no one-task windows over data, pruned scans."""
import re

import pytest
from conftest import SF

from touchline.plans import catalog

JOINS = ["m0_upcoming_value", "j6_live_row_to_match", "j7_stale_by_lenient_names", "j8_stale_by_day_window", "j9_absence_to_match", "j16_names_loose",
         "j18_entities_scored", "j12_table_before_kickoff", "f12_context_scores", "u5_isotonic_fit", "j26_calibrated_probs", "u3_walk_forward_league",
         "t7_hit_variants", "t6_suggested_coupons", "a22_ev_grid_top30", "j21_diff", "w13_rolling_calibration"]


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", JOINS)
def test_no_nested_loops(spark, name):
    assert not re.search("BroadcastNestedLoopJoin|CartesianProduct", plan(spark, name))


def test_market_expansion_does_not_shuffle_beyond_the_input_spread(spark):
    p = plan(spark, "a13_full_payload").split("== Physical Plan ==")[1]
    assert p.count("Exchange") <= 1 and "Expand" in p and "Window" not in p


def test_scan_reads_only_what_it_needs(spark):
    p = plan(spark, "w7_best_price_last_wins")
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", p)[0]
    assert "o_totalprice" not in schema and "o_orderpriority" not in schema
    assert "PushedFilters: [" in plan(spark, "m0_upcoming_value") and "o_orderstatus" in plan(spark, "m0_upcoming_value")


def test_ranked_filters_are_cut_before_their_shuffle(spark):
    assert plan(spark, "a3_form").count("WindowGroupLimit") >= 2
    assert "WindowGroupLimit" in plan(spark, "w9_best_pick_per_match")
