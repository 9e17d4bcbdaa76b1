"""Every registered query at the smallest scale; those with SQL against DuckDB."""

import check_oracle
import pytest

import __spark_entry__ as entry
from strideflow.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()
FNS, SQL = registry.QUERIES, registry.ORACLES
#: What identifies a row in the results that SQL does not check; also columns that are never null.
KEYS = {
    "a16_gap_fill_stats": ["video_id"], "a18_panel": ["video_id", "phase"], "e14_refine_contacts": ["video_id"], "e21_refine_v2_select": ["video_id", "frame_idx"],
    "e23_gap_fill": ["video_id", "frame_idx"], "e29_learned_first": ["video_id", "frame_idx"], "e29_learned_refined": ["video_id", "frame_idx"],
    "e29_learned_v2": ["video_id", "frame_idx"], "e30_auto_keyframes": ["video_id", "frame_idx"], "e5_detect_contacts": ["video_id"],
    "f34_align_pose": ["video_id", "frame_idx", "name"], "j18_reference_pose": ["video_id", "phase"], "j19_mid_flight_reference": ["video_id"],
    "j20_prefer_pass": ["video_id"], "j23_phase_frame": ["video_id", "phase"], "k7_seed_gt": ["video_id", "phase"], "m8_analyze_sections": ["video_id"],
    "m8_section_phases": ["video_id"], "u5_replace_propagated": ["video_id"],
}
#: Results with several rows a key.
REPEATED = {"k7_seed_gt", "e14_refine_contacts", "e5_detect_contacts", "m8_analyze_sections", "m8_section_phases", "u5_replace_propagated", "j19_mid_flight_reference"}


@pytest.fixture(scope="module")
def con():
    return check_oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    problem, _ = check_oracle.compare(spark, con, SF, name, FNS[name], SQL[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(FNS) - set(SQL)))
def test_rows_are_keyed(spark, name):
    rows = FNS[name](spark, SF).select(*KEYS[name]).collect()
    assert rows and all(v is not None for r in rows for v in r)
    assert name in REPEATED or len(set(rows)) == len(rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_queries_are_registered():
    assert set(FNS) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
