import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourlake.functions.labels import severity, severity_rank, strip_prefix, surrogate_key, valid_key, wind_to_kph, wmo_text
from hourlake.functions.numbers import leading_number, pct, safe_double
from hourlake.functions.times import bucket_start, parse_period, parse_utc, resolution_minutes, seconds_between


def values(frame, inputs, fn, kind="string"):
    df = frame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn("v").alias("out")).orderBy("i").collect()]


def naive(*parts):
    return dt.datetime(*parts)


def test_periods(frame):
    got = values(frame, ["2026-06-17T00", "2026-06-17 05", "2026-06-17T05:30:00", "junk", None], lambda c: parse_period(c).cast("timestamp_ntz"))
    assert got == [naive(2026, 6, 17), naive(2026, 6, 17, 5), naive(2026, 6, 17, 5, 30), None, None]


def test_times_with_and_without_zone(frame):
    texts = ["2026-01-01 02:00:00", "2026-01-01T02:00Z", "2026-01-01T02:00:00+02:00", "", None]
    want = [naive(2026, 1, 1, 2), naive(2026, 1, 1, 2), naive(2026, 1, 1), None, None]
    texts += ["2026-01-01T02", "2026-01-01T02Z", "2026-01-01 02:30", "2026-01-01T02:30z", "2026-01-01T02:00+0200", "2026-01-01T02+02", " 2026-01-01 02:30:01.5Z ", "2026-01-01", "x" * 13]
    want += [naive(2026, 1, 1, 2), naive(2026, 1, 1, 2), naive(2026, 1, 1, 2, 30), naive(2026, 1, 1, 2, 30), naive(2026, 1, 1), naive(2026, 1, 1), naive(2026, 1, 1, 2, 30, 1, 500000), None, None]
    for parse in (parse_utc, parse_period):
        assert values(frame, texts, lambda c: parse(c).cast("timestamp_ntz")) == want


def test_numbers(frame):
    assert values(frame, ["", None, "abc", "12.5", "7", "1d", "nan", " -3e2 ", ".5"], safe_double) == [
        None, None, None, 12.5, 7.0, None, None, -300.0, 0.5
    ]
    assert values(frame, ["12 mph", "x", "", "-4.5"], leading_number) == [12.0, None, None, -4.5]


def test_resolution(frame):
    assert values(frame, ["PT15M", "PT30M", "PT60M", "PT1H", "P1D", "?", "PT1234567M"], resolution_minutes) == [15, 30, 60, 60, 60, 60, 1234567]


def test_wind(frame):
    got = values(frame, ["10 mph", "10 to 15 mph", "20 kph", "calm", "", None, "x10 1e3 mph", ".5 5. mph"], wind_to_kph)
    assert got[:3] == pytest.approx([16.09344, 20.1168, 32.18688])
    assert got[3:7] == [None, None, None, None] and got[7] == pytest.approx(2.75 * 1.609344)


def test_weather_codes(frame):
    assert values(frame, [0, 95, None, 123], wmo_text, "int") == ["Clear sky", "Thunderstorm", None, "WMO 123"]


def test_severity(frame):
    assert values(frame, [1.9, -2.0, 3.0, 2.99], severity, "double") == ["info", "warn", "critical", "warn"]
    assert values(frame, ["CRITICAL", "High", "severe", "moderate", "low", None], severity_rank) == [3, 2, 2, 1, 0, 0]


def test_keys(frame):
    assert values(frame, ["PJM", "10YFR-RTE------C", "a b", "", None, "x" * 21], valid_key) == [True, True, False, False, False, False]
    assert values(frame, ["BA:PJM", "BA:BA:X"], lambda c: strip_prefix(c, "BA:")) == ["PJM", "BA:X"]
    assert values(frame, ["a", None], surrogate_key)[0] == "0cc175b9c0f1b6a831c399e269772661"


def test_percent_rules(frame):
    df = frame([(1.0, 4.0), (1.0, 0.0), (1.0, -4.0), (None, 4.0)], "n double, d double")
    rows = df.select(pct("n", "d").alias("a"), pct("n", "d", "nullif").alias("b"), pct("n", "d", "abs").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(25.0, 25.0, 25.0), (None, None, None), (None, -25.0, 25.0), (None, None, None)]


def test_buckets_do_not_depend_on_the_session_zone(spark, frame):
    df = spark.sql("SELECT timestamp_ntz'2026-03-08 02:30:00' AS t")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = df.select(bucket_start("t", "1 hour").alias("h"), seconds_between(F.lit("2026-03-08").cast("timestamp_ntz"), "t").alias("s")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.h, row.s) == (naive(2026, 3, 8, 2), 9000.0)
