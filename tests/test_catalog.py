"""Registered queries against their check SQL on the smallest tables.

A spread of queries runs by default; set PREGONERO_ALL=1 to run every one.
"""

import os

import pytest

from catalog import CHECKS, QUERIES
from catalog.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a9_facets", "a15_analysis_by_state", "a18_national_distribution", "a20_by_buyer", "a22_over_time_semana", "a31_last_cursor", "a35_extraction_overall",
    "c7_contract_by_score", "f11_combined_filters", "g2_call_range", "g13_confidence", "g16_composite_parse", "j6_u5_patch_by_agency_and_object",
    "l1_page", "n1_portal_normalise", "n3_gazette_json_normalise", "n4_ocds_zip_normalise", "s7_s20_g1_marked_text_pages", "s14_f18_link_harvest",
    "t6_missing_editions", "t8_live_counts_stream", "u1_j7_insert_if_absent", "u2_upsert", "u4_backfill", "x5_gazette_date", "x18_cell_unwrap",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES) and set(SAMPLE) <= set(QUERIES)
    assert len(CHECKS) >= len(QUERIES) - 5


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("PREGONERO_ALL") else SAMPLE)
def test_query_matches_check(spark, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
