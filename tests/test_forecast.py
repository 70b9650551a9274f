import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest

from hourlake.operators import forecast

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "ba_code string, period_utc timestamp_ntz, value_mwh double"


def hours(key, n, fn, skip=()):
    return [(key, T0 + dt.timedelta(hours=h), fn(h)) for h in range(n) if h not in skip]


def wave(h):
    return 100 + 30 * math.sin(h / 24 * 2 * math.pi) + random.Random(h).uniform(-3, 3)


ROWS = (
    hours("wave", 330, wave, skip={50, 51, 52, 200})
    + hours("flat", 120, lambda h: 42.0)
    + hours("short", 71, wave)
    + hours("edge", 72, wave)
    + hours("nulls", 200, lambda h: None)
    + [("wave", T0 + dt.timedelta(hours=60, minutes=0), None)]
)


@pytest.fixture(scope="module")
def demand(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def gridded(key):
    df = pd.DataFrame([r for r in ROWS if r[0] == key], columns=["k", "t", "v"]).dropna().sort_values("t").set_index("t")
    return df[~df.index.duplicated(keep="last")]["v"].asfreq("h").interpolate("linear").ffill().bfill()


def test_short_and_empty_keys_are_skipped(demand):
    counts = {r.ba_code: r["count"] for r in forecast.regular_grid(forecast.history(demand, days=20)).groupBy("ba_code").count().collect()}
    assert counts == {"wave": 330, "flat": 120, "edge": 72}


def test_anomaly_scores_match_a_pandas_twin(demand):
    got = forecast.anomaly_scan(demand).toPandas()
    for key in ("wave", "flat"):
        v = gridded(key)
        profile = v.groupby(v.index.hour).mean()
        shape = pd.Series(v.index.hour, index=v.index).map(profile) / profile.mean()
        expected = (v.rolling(168, min_periods=24).mean().shift(1) * shape).bfill().ffill()
        residual = v - expected
        spread = residual.rolling(168, min_periods=24).std()
        # deviations that are zero but for rounding stand for no deviation
        spread = spread.where(spread > 1e-9).bfill().ffill()
        z = (residual / spread).fillna(0.0).tail(24)
        mine = got[got.ba_code == key].sort_values("period_utc")
        assert len(mine) == 24
        np.testing.assert_allclose(mine.expected_mwh, expected.tail(24), rtol=1e-9)
        if key == "wave":
            np.testing.assert_allclose(mine.z_score, z, rtol=1e-6)


def test_seasonal_naive_repeats_the_last_day(demand):
    out = forecast.seasonal_naive(demand, horizon=30).toPandas()
    mine = out[out.ba_code == "wave"].sort_values("period_utc")
    v = gridded("wave")
    np.testing.assert_allclose(mine.yhat_mwh, np.tile(v.tail(24).to_numpy(), 2)[:30], rtol=1e-12)
    np.testing.assert_allclose(mine.yhat_upper - mine.yhat_mwh, 1.28 * np.std(v.tail(168)), rtol=1e-9)
    assert mine.period_utc.iloc[0] == T0 + dt.timedelta(hours=330)
    flat = out[out.ba_code == "flat"]
    np.testing.assert_allclose(flat.yhat_upper - flat.yhat_mwh, 1.28)


def test_keys_without_a_fit_fall_back(demand):
    vintage = forecast.demand_forecast(demand)
    used = {(r.ba_code, r.model_name) for r in vintage.select("ba_code", "model_name").distinct().collect()}
    assert used == {("wave", forecast.AR_MODEL), ("edge", forecast.AR_MODEL), ("flat", forecast.NAIVE_MODEL)}
    report = {r.model_name: r["keys"] for r in forecast.model_report(demand, vintage).collect()}
    assert report == {forecast.AR_MODEL: 2, forecast.NAIVE_MODEL: 1, "none": 2}


def test_accuracy_uses_the_latest_vintage_and_realised_hours(frame):
    t = [T0 + dt.timedelta(hours=h) for h in range(4)]
    actual = frame([("a", t[0], 10.0), ("a", t[1], 0.0), ("a", t[2], 20.0)], SCHEMA)
    vint = frame(
        [("a", t[2], 99.0, t[0]), ("a", t[2], 18.0, t[1]), ("a", t[1], 1.0, t[0]), ("a", t[3], 5.0, t[0])],
        "ba_code string, period_utc timestamp_ntz, yhat_mwh double, fit_at_utc timestamp_ntz",
    )
    rows = {(r.source, r.is_total): r for r in forecast.forecast_accuracy(vint, actual.limit(0), actual).collect()}
    assert (rows["model", True].pairs, rows["model", True].mape_pct) == (2, pytest.approx(10.0))
    assert rows["day_ahead", True].pairs == 0 and ("day_ahead", False) not in rows


def test_custom_forecaster_runs_per_key(demand):
    def constant(values, horizon):
        return [values[-1]] * horizon, [0.0] * horizon, [1.0] * horizon

    out = forecast.forecast_with(demand, constant, horizon=3).toPandas()
    assert sorted(out.ba_code.unique()) == ["edge", "flat", "wave"] and len(out) == 9


def test_last_row_of_an_hour_counts_and_off_grid_rows_are_reported(frame):
    rows = [("a", dt.datetime(2026, 1, 1) + dt.timedelta(minutes=15 * i), float(i), 1) for i in range(400)]
    rows += [("a", dt.datetime(2026, 1, 1), 99.0, 0), ("b", dt.datetime(2026, 1, 1), 1.0, 0)]
    df = frame(rows, "ba_code string, period_utc timestamp_ntz, value_mwh double, seen int")
    first = lambda **k: forecast.regular_grid(df, **k).orderBy("period_utc").first().value_mwh
    assert first() == 99.0 and first(order_col="seen") == 0.0
    report = {r.ba_code: (r.n_rows, r.off_grid, r.repeated, r.used) for r in forecast.grid_report(df).collect()}
    assert report == {"a": (401, 300, 1, True), "b": (1, 0, 0, False)}
