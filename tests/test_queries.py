"""Registered queries against their SQL. FULL=1 runs all of them, else one of each kind."""
import os

import pytest
from conftest import SF

from compare import check, connect
from touchline.plans import catalog

SAMPLE = """m0_upcoming_value f2_score_matrix a7_over_under_lines a11_asian_handicap_lines t1_top_correct_scores a13_full_payload w7_best_price_last_wins
 f4_edges w1_record_before_kickoff j12_table_before_kickoff f7_motivation a4_form_delta f8_adjusted_rates f14_settlement u8_accuracy_rows a16_calibration_bins
 a19_roi_by_threshold a21_correct_score_quality a22_ev_grid_top30 w12_timeline_index u5_isotonic_fit j26_calibrated_probs p8_strict_picks f12_context_scores
 t7_hit_variants f26_coupon_signature a28_coupon_settlement a25_monthly_pnl u3_fold_training_sums u6_prediction_batch s1_season_files s6_odds_documents
 s13_scoreboard j15_names_exact j16_names_loose j18_entities_scored j6_live_row_to_match j8_stale_by_day_window j21_diff s20_new_coupons st1_live_fold""".split()
NAMES = sorted(catalog.QUERIES) if os.environ.get("FULL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    rows, result = check(spark, con, SF, name)
    assert result in ("ok", None)
    assert rows > 0 or name == "j22_ghosts_nothing_listed"


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
