"""Every SQL oracle on the smallest test tables (streaming queries run in tests/check.py)."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, diff

SF = "/root/testdata/sf0.001"
PICK = ["flagship", "src_tracks_csv", "join_neighbor_context", "win_debounce", "wnd_full_vector", "agg_subset_grid",
        "rep_lc_feasibility", "smp_split_assign", "hmm_posterior", "em_expected_counts", "prd_next_state", "udf_masked_slope"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("key", PICK)
def test_query_matches_sql(spark, key):
    assert diff(entry.queries()[key](spark, SF), connect(SF), entry.oracle_sql()[key]) is None


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
