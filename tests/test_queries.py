import re

import pytest

import __spark_entry__ as entry
from hourlake.queries import COVERS, ORACLES, QUERIES
from tests.compare import differences, oracle

QUICK = [
    "demand_headline", "fact_demand_hourly", "demand_recent", "generation_share", "mirror_pairs", "forecast_accuracy",
    "seasonal_ar1_forecast", "anomaly_scan", "rolling_mean", "interpolate_in_time", "fuel_bands", "trim_incomplete_tail",
    "energy_balance", "validation_report", "region_pages_to_demand", "load_documents",
]


def test_every_query_names_what_it_covers():
    assert set(COVERS) == set(QUERIES) and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    ids = {i for covered in COVERS.values() for i in covered}
    groups = {"SRC": 13, "NRM": 14, "SNK": 12, "PRJ": 14, "JON": 10, "AGG": 28, "WIN": 13, "TOP": 9, "SET": 4, "FC": 8, "DQ": 11, "STR": 7}
    wanted = {f"{g}{i}" for g, n in groups.items() for i in range(1, n + 1)}
    assert ids == wanted
    assert all(re.fullmatch("[a-z][a-z0-9_]*", n) for n in COVERS)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert differences(got, oracle(sf_dir).execute(entry.oracle_sql()[name]).df()) is None


IN_JVM = ["demand_headline", "anomaly_scan", "forecast_accuracy", "lags_by_rows", "interpolate_in_time", "fuel_band_series", "validation_report"]


@pytest.mark.parametrize("name", IN_JVM)
def test_plans_stay_in_the_jvm_and_off_single_partition_windows(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line_before, line in zip(plan.splitlines(), plan.splitlines()[1:]):
        assert not ("Window" in line_before and "SinglePartition" in line)
