"""Registered queries against their check SQL (one or two per family; compare.py runs all)."""

import pytest
from compare import compare, oracle

import __spark_entry__ as entry

# Operators per family that must be registered.
FAMILIES = {
    "a": 13, "b": 13, "c": 18, "d": 19, "e": 13, "f": 6, "g": 4, "h": 15, "i": 23, "j": 27, "k": 8, "l": 14, "m": 25,
    "n": 11, "o": 17, "p": 17, "q": 30, "r": 21, "s": 10, "t": 6, "u": 5, "v": 4, "w": 8,
}
SAMPLE = [
    "a8_bronze_landing", "b4_clean_orders", "c9_scd2_range_join", "c10_asof_join", "d10_subtotals_cube", "d19_daily_mart", "e7_year_over_year",
    "f3_top_n_others", "g3_except_both_ways", "h12_currency_convert", "i1_profile", "i6_timestamp_gaps", "j22_contract_rules", "j25_quarantine",
    "k5_row_diff", "l3_ks_statistic", "m7_scd2_rerun", "m8_scd2_from_history", "n2_upsert", "o8_measure_variants", "p4_cohort_retention",
    "q14_benjamini_hochberg", "r9_auc", "s2_windowed_kpi", "t6_pii_scan", "u5_downstream_lineage", "v4_table_function", "w7_rank_change",
]


def test_every_operator_has_a_query():
    names = {n.split("_")[0] for n in entry.queries()}
    missing = [f"{f}{i}" for f, n in FAMILIES.items() for i in range(1, n + 1) if f"{f}{i}" not in names]
    assert not missing
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(data):
    return oracle(data)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, data, con, name):
    got = entry.queries()[name](spark, data).toArrow()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    problems = [p for p in compare(got, want) if "EMPTY" not in p]
    assert not problems, problems


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["m13_star_fact", "c11_interval_agg"])
def test_cells_are_not_broadcast(spark, data, name):
    """Unfolded versions and intervals grow with the data, whatever the planner takes them for."""
    df = entry.queries()[name](spark, data)
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "_cell#" in x and "Join" in x]
    assert lines and all("SortMergeJoin" in x for x in lines)


def test_orders_of_a_fact_are_not_broadcast(spark, data):
    """Orders grow with the lines; in memory they take ten times what their files do."""
    df = entry.queries()["m13_star_fact"](spark, data)
    assert not [p for p in df.inputFiles() if "orders" in p]  # joined and written before
    from tidemark.plans.registry import Tables

    plan = Tables(spark, data).order_lines._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
