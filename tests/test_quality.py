import datetime as dt

import pytest

from hourlake.operators import quality, ranking, rollups
from hourlake.sources.tables import source_sla

T0 = dt.datetime(2026, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def buckets(frame, counts, values=None):
    rows = [(at(i), c, float((values or counts)[i])) for i, c in enumerate(counts)]
    return frame(rows, "t timestamp_ntz, c int, v double")


@pytest.mark.parametrize(
    ("counts", "values", "kept"),
    [
        ([10] * 8 + [5], None, 8),
        ([10] * 8 + [5] * 3, None, 8),
        ([10] * 8 + [5] * 4, None, 9),
        ([10, 10, 2, 10, 10, 10], None, 6),
        ([10] * 6, [100, 100, 100, 100, 100, 50], 5),
        ([1, 1, 0], None, 3),
        ([10, 10, 10, 1], None, 3),
        ([0, 0, 0, 0, 0], None, 5),
        ([], None, 0),
    ],
)
def test_trailing_trim(frame, counts, values, kept):
    df = buckets(frame, counts, values)
    left = ranking.drop_incomplete_tail(df, "t", "c", "v").collect()
    assert sorted(r.t for r in left) == [at(i) for i in range(kept)]
    grouped = ranking.drop_incomplete_tail(df.selectExpr("'k' AS k", "*"), "t", "c", "v", ["k"])
    assert grouped.count() == kept


def test_trim_is_done_per_series(frame):
    rows = [("a", at(i), 10, 10.0 if i < 5 else 1.0) for i in range(6)] + [("b", at(i), 10, 10.0) for i in range(6)]
    df = frame(rows, "k string, t timestamp_ntz, c int, v double")
    left = ranking.drop_incomplete_tail(df, "t", "c", "v", ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in left} == {"a": 5, "b": 6}


def test_staleness(spark, frame):
    now = at(100)
    rows = [
        ("EIA-region", at(99), at(98)),
        ("EIA-fuel", at(96), at(99)),
        ("NOAA", at(50), at(99)),
        ("Unknown", at(1), at(98)),
        ("OpenMeteo", None, None),
        ("ENTSOE-load", at(90), at(96)),
    ]
    fresh = frame(rows, "source string, last_period_utc timestamp_ntz, last_fetch_utc timestamp_ntz")
    got = {r.source: r.stale_reason for r in quality.staleness(fresh, source_sla(spark), now).collect()}
    assert got == {
        "EIA-region": None,
        "EIA-fuel": None,
        "NOAA": "no successful fetch in 1.0h (SLA 1h)",
        "Unknown": None,
        "OpenMeteo": "never fetched",
        "ENTSOE-load": "no successful fetch in 4.0h (SLA 3h); data 10.0h old (SLA 6h)",
    }
    assert quality.check_freshness(fresh, source_sla(spark), now).first().status == "warn"
    assert quality.check_freshness(fresh.where("source = 'NOAA'"), source_sla(spark), now).first().status == "fail"
    assert quality.check_freshness(fresh.limit(0), source_sla(spark), now).first().status == "pass"


def test_balance_needs_all_three_series(frame):
    def hour(ba, h, d, ng, ti):
        return [(at(h), ba, s, v) for s, v in (("D", d), ("NG", ng), ("TI", ti)) if v is not None]

    rows = hour("ok", 0, 90.0, 100.0, 10.0) + hour("ok", 1, 90.0, None, 10.0) + hour("off", 0, 50.0, 100.0, 10.0)
    rows += hour("zero", 0, 0.0, 1.0, 1.0) + hour("late", 9, 1.0, 1.0, 1.0)
    df = frame(rows, "period_utc timestamp_ntz, ba_code string, series string, value_mwh double")
    got = {r.ba_code: r for r in quality.energy_balance(df, at(10)).collect()}
    assert set(got) == {"ok", "off"}
    assert (got["ok"].status, got["ok"].hours, got["ok"].residual_pct) == ("pass", 1, 0.0)
    assert (got["off"].status, got["off"].residual_mwh, got["off"].residual_pct) == ("warn", 40.0, 80.0)
    assert quality.check_energy_balance(df, at(10)).first().value == "1 of 2 BAs reconcile; 1 flagged"
    empty = quality.check_energy_balance(df.limit(0), at(10)).first()
    assert (empty.status, empty.value) == ("pass", "awaiting settled data (feeds still backfilling)")


def test_plausibility_levels(frame):
    schema = "period_utc timestamp_ntz, ba_code string, value_mwh double"
    good = [(at(h), "a", 5.0) for h in range(23)] * 3
    status = lambda rows: quality.check_plausibility(frame(rows, schema), at(23)).first().status
    assert status(good) == "pass"
    assert status(good + [(at(5), "b", None)]) == "warn"
    assert status(good + [(at(5), "b", 0.0), (at(6), "b", None)]) == "fail"
    assert status([]) == "pass"


def test_source_priority_and_column_tests(frame):
    df = frame([("k", "DEMO", 1.0), ("k", "EIA", 2.0), ("j", "other", 3.0)], "k string, source string, v double")
    best = {r.k: r.v for r in quality.resolve_source(df, ["k"], ["EIA", "DEMO"]).collect()}
    assert best == {"k": 2.0, "j": 3.0}
    tests = {r.test: r.failures for r in quality.column_tests(df, ["v"], ["k", "source"], {"small": "v < 3"}).collect()}
    assert tests == {"not_null_v": 0, "unique_k": 1, "unique_source": 0, "small": 1}


def test_fuel_bands(frame):
    rows = [
        ("NG", "Natural Gas", 500.0, 50.0), ("SUN", "Solar", 1.0, 0.1), ("OTH", "Other", 200.0, 20.0), ("BAT", None, 30.0, 3.0),
        ("SNB", None, 90.0, 9.0), ("GEO", "Geothermal", 10.0, 1.0), ("PS", None, 40.0, 4.0),
    ]
    share = frame(rows, "fuel_code string, fuel_name string, mwh double, pct double")
    got = {r.fuel_code: r.band for r in ranking.fuel_bands(share).collect()}
    assert got == {"NG": "Natural Gas", "SUN": "Solar", "OTH": "Other", "BAT": "Battery", "SNB": "Other", "GEO": "Other", "PS": "Pumped Storage"}
    assert {r.band: r.pct for r in ranking.band_shares(ranking.fuel_bands(share)).collect()}["Other"] == pytest.approx(30.0)


def test_top_n_without_a_rest_has_no_other(frame):
    df = frame([(at(0), z, v) for z, v in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "period_utc timestamp_ntz, z string, v double")
    assert {r.band for r in ranking.top_n_other(df, "z", "v", 3).collect()} == {"a", "b", "c"}
    assert {r.band: r.v for r in ranking.top_n_other(df, "z", "v", 1).collect()} == {"a": 3.0, "Other": 3.0}


def test_ties_in_extremes_are_broken_by_the_kept_columns(frame):
    df = frame([("x", 1.0), ("y", 1.0), ("z", None)], "k string, v double")
    assert rollups.arg_extreme(df, "v", "max", keep=["k", "v"]).first().k == "y"
    assert rollups.arg_extreme(df, "v", "min", keep=["k", "v"]).first().k == "x"


def test_trimming_does_not_collect_and_takes_a_window(frame):
    start = dt.datetime(2026, 1, 1)
    rows = [(start + dt.timedelta(hours=h), 10, 100.0 if h < 90 else 10.0) for h in range(100)]
    rows[-1] = (rows[-1][0], 10, 1.0)
    df = frame(rows, "t timestamp_ntz, c int, v double")
    tail = ranking.incomplete_tail(df, "t", "c", "v")
    assert "collect_list" not in tail._jdf.queryExecution().toString()
    assert [tuple(r) for r in tail.collect()] == [(3, start + dt.timedelta(hours=97))]
    assert [tuple(r) for r in ranking.incomplete_tail(df, "t", "c", "v", hours=9).collect()] == [(1, start + dt.timedelta(hours=99))]
