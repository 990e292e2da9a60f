"""The combined analysis has all of the reference's parts."""

from trajix.plans.queries import QUERIES


def test_combined_analysis_is_whole(spark, tables):
    whole = QUERIES["analyze_all_frames"](spark, tables)
    assert set(whole.columns) == {"frame", "rmsd", "rg", "cx", "cy", "cz", "sasa", "n_hbonds", "n_contacts"}
    areas = {r["frame"]: r["area"] for r in QUERIES["sasa_total"](spark, tables).collect()}
    assert {r["frame"]: r["sasa"] for r in whole.collect()} == areas and min(areas.values()) > 0
    rmsf = QUERIES["rmsf"](spark, tables).collect()
    assert sorted(QUERIES["analyze_all_atoms"](spark, tables).collect()) == sorted(rmsf) and len(rmsf) == 21
