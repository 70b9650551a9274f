import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W, functions as F

from hourlake.operators import rollups, windows

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "ba_code string, period_utc timestamp_ntz, v double"


def history(hours=400, seed=7):
    """Three keys with gaps and nulls, one of them with most rows."""
    rng = random.Random(seed)
    rows = []
    for key, share in (("hot", 1.0), ("thin", 0.4), ("mid", 0.8)):
        for h in range(hours):
            if rng.random() < share:
                rows.append((key, T0 + dt.timedelta(hours=h), None if rng.random() < 0.15 else round(rng.uniform(1, 9), 3)))
    rows += [("empty", T0 + dt.timedelta(hours=h), None) for h in range(30)]
    return rows


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(history(), SCHEMA).cache()


def same(a, b, columns):
    left, right = (sorted(map(tuple, d.select("ba_code", "period_utc", *columns).collect()), key=str) for d in (a, b))
    assert len(left) == len(right)
    for x, y in zip(left, right):
        assert x[:2] == y[:2]
        for p, q in zip(x[2:], y[2:]):
            assert (p is None) == (q is None) and (p is None or p == pytest.approx(q, rel=1e-9))


def plain():
    return W.partitionBy("ba_code").orderBy("period_utc")


def test_row_numbers_match_the_plain_window(series):
    got = windows.number_rows(series, ["ba_code"], "period_utc", "n", piece="1 day")
    same(got, series.withColumn("n", F.row_number().over(plain())), ["n"])


def test_lags_in_blocks_match_the_plain_window(series):
    got = windows.with_lags(series, ["ba_code"], "period_utc", "v", [1, 24], block_rows=50)
    want = series.withColumns({"lag_1": F.lag("v", 1).over(plain()), "lag_24": F.lag("v", 24).over(plain())})
    same(got, want, ["v", "lag_1", "lag_24"])


@pytest.mark.parametrize(("fn", "shift"), [("avg", 0), ("avg", 1), ("stddev_samp", 0)])
def test_rolling_in_blocks_matches_pandas(series, fn, shift):
    got = windows.rolling(series, ["ba_code"], "period_utc", "v", fn, 48, 12, shift, "r", block_rows=60).toPandas()
    pdf = pd.DataFrame(history(), columns=["ba_code", "period_utc", "v"]).sort_values(["ba_code", "period_utc"])
    roll = lambda s: getattr(s.astype(float).rolling(48, min_periods=12), "mean" if fn == "avg" else "std")().shift(shift)
    if shift:  # a shifted frame counts its own rows
        roll = lambda s: s.astype(float).shift(1).rolling(48, min_periods=12).mean()
    pdf["want"] = pdf.groupby("ba_code")["v"].transform(roll)
    both = got.merge(pdf[["ba_code", "period_utc", "want"]], on=["ba_code", "period_utc"])
    assert len(both) == len(pdf)
    np.testing.assert_allclose(both["r"].astype(float), both["want"].astype(float), rtol=1e-9)


def test_fill_and_interpolate_across_pieces(series):
    pdf = pd.DataFrame(history(), columns=["ba_code", "period_utc", "v"]).sort_values(["ba_code", "period_utc"])
    pdf["bf"] = pdf.groupby("ba_code")["v"].transform(lambda s: s.astype(float).bfill().ffill())
    pdf["line"] = pdf.groupby("ba_code", group_keys=False)[["period_utc", "v"]].apply(
        lambda g: pd.Series(g.set_index("period_utc")["v"].astype(float).interpolate("time", limit_area="inside").to_numpy(), index=g.index)
    )
    for got, want in (
        (windows.fill(series, ["ba_code"], "period_utc", "v", "bf", piece="1 day"), "bf"),
        (windows.interpolate(series, ["ba_code"], "period_utc", "v", piece="1 day"), "line"),
    ):
        both = got.toPandas().merge(pdf[["ba_code", "period_utc", want]], on=["ba_code", "period_utc"])
        assert len(both) == len(pdf)
        np.testing.assert_allclose(both["v"].astype(float), both[want].astype(float), rtol=1e-9)


def test_headline_uses_each_keys_own_rows(frame):
    rows = [("a", T0 + dt.timedelta(hours=h), float(h)) for h in range(30)] + [("b", T0 + dt.timedelta(hours=h), 100.0) for h in range(20)]
    demand = frame(rows, "ba_code string, period_utc timestamp_ntz, value_mwh double")
    own = windows.demand_headline(demand).first()
    assert (own.total_mwh_now, own.total_mwh_24h_ago, own.bas) == (129.0, 5.0, 2)
    common = windows.demand_headline(demand, aligned=True).first()
    assert (common.total_mwh_now, common.total_mwh_24h_ago, common.bas) == (29.0, 105.0, 1)
    none = windows.demand_headline(demand.limit(0)).first()
    assert (none.total_mwh_now, none.bas, none.delta_pct) == (None, 0, None)


def test_latest_vintage_and_nearest_reading(frame):
    at = T0 + dt.timedelta(hours=1)
    v = frame([("a", at, 1.0, T0), ("a", at, 2.0, at)], "ba_code string, period_utc timestamp_ntz, yhat_mwh double, fit_at_utc timestamp_ntz")
    assert windows.latest_vintage(v, ["ba_code", "period_utc"]).first().yhat_mwh == 2.0
    w = frame([("s", T0 + dt.timedelta(hours=h)) for h in (0, 2, 40)], "station_id string, period_utc timestamp_ntz")
    now = T0 + dt.timedelta(hours=1, minutes=50)
    assert windows.latest_readings(w, now).first().period_utc == T0 + dt.timedelta(hours=40)
    assert windows.latest_readings(w, now, mode="nearest").first().period_utc == T0 + dt.timedelta(hours=2)


def test_percent_of_peak_drops_negatives(frame):
    t = frame([("a", 50.0, -5.0), ("a", 100.0, 200.0), ("z", -1.0, None)], "ba_code string, actual double, yhat double")
    rows = sorted(map(tuple, windows.pct_of_peak(t).select("ba_code", "actual_pct", "yhat_pct").collect()), key=str)
    assert rows == [("a", 25.0, None), ("a", 50.0, 100.0), ("z", None, None)]


def test_minmax_of_equal_values(frame):
    assert [r.s for r in windows.minmax01(frame([(3.0,), (3.0,), (None,)], "v double"), "v", "s").collect()] == [0.0, 0.0, None]


def test_mirror_pairs_do_not_depend_on_direction(frame):
    rows = [("A", "B", 10.0), ("B", "A", -20.0), ("C", "A", 7.0), ("D", "E", 5.0), ("E", "D", 5.0)]
    flows = frame(rows, "from_ba string, to_ba string, net_mwh double")
    flipped = frame([(b, a, -v) for a, b, v in rows], "from_ba string, to_ba string, net_mwh double")
    got = [tuple(r) for r in rollups.mirror_pairs(flows).collect()]
    assert got == [tuple(r) for r in rollups.mirror_pairs(flipped).collect()]
    assert got == [("A", "B", 0.015), ("C", "A", 0.007), ("D", "E", 0.0)]


def test_score_sets_keep_the_total_on_empty_input(frame):
    schema = "ba_code string, actual double, yhat double"
    total = rollups.score_sets(frame([], schema)).collect()
    assert [(r.is_total, r.pairs, r.mape_pct) for r in total] == [(True, 0, None)]
    assert rollups.score_grouping_sets(frame([], schema)).count() == 0
    rows = {r.ba_code: r for r in rollups.score_sets(frame([("a", 10.0, 9.0), ("a", 0.0, 1.0)], schema)).collect()}
    assert (rows["a"].pairs, rows["a"].mape_pct, rows["a"].rmse_mwh) == (2, 10.0, 1.0)


@pytest.mark.parametrize("piece", ["1 day", 40])
def test_any_piece_gives_the_plain_result(series, piece):
    got = windows.rolling(series, ["ba_code"], "period_utc", "v", "sum", 24, 1, 0, "r", block_rows=60, piece=piece)
    same(got, series.withColumn("r", F.sum("v").over(plain().rowsBetween(-23, 0))), ["r"])
    got = windows.with_lags(series, ["ba_code"], "period_utc", "v", [3], block_rows=50, piece=piece)
    same(got, series.withColumn("lag_3", F.lag("v", 3).over(plain())), ["lag_3"])
    got = windows.fill(series, ["ba_code"], "period_utc", "v", "f", piece)
    same(got, series.withColumn("v", F.last("v", True).over(plain().rowsBetween(W.unboundedPreceding, 0))), ["v"])


def test_pieces_of_a_busy_key_are_bounded_by_rows(spark):
    busy = spark.range(20_000).selectExpr("IF(id % 100 = 0, 'thin', 'busy') AS ba_code", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id * 7) AS period_utc", "CAST(id AS DOUBLE) AS v")
    sizes = windows.with_pieces(busy, ["ba_code"], "period_utc", 1000).groupBy("ba_code", "_piece").count().collect()
    assert max(r["count"] for r in sizes) <= 1000 + 515 and sum(r["count"] for r in sizes) == 20_000
    got = windows.number_rows(busy, ["ba_code"], "period_utc", "n", piece=1000)
    same(got, busy.withColumn("n", F.row_number().over(plain())), ["n"])


def test_lags_by_time_keep_all_columns(series):
    named = series.withColumn("note", F.concat("ba_code", F.lit("!")))
    by_time = windows.with_lags(named, ["ba_code"], "period_utc", "v", [24], "time")
    assert by_time.columns == windows.with_lags(named, ["ba_code"], "period_utc", "v", [24]).columns
    assert by_time.where("note = concat(ba_code, '!')").count() == named.count()


def test_one_busy_hour_of_a_busy_key_is_cut_too(spark):
    """99 % of the rows have one key and lie within one hour."""
    micros = "CASE WHEN id % 100 = 0 THEN id * 3600 WHEN id < 300 THEN id * 900 ELSE 5000000 + id * 0.1 END"
    busy = spark.range(12_000).selectExpr(
        "IF(id % 100 = 0, 'thin', 'busy') AS ba_code", f"timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, {micros}) AS period_utc",
        "IF(id % 7 = 0, NULL, CAST(id % 13 AS DOUBLE)) AS v",
    )
    sizes = windows.with_pieces(busy, ["ba_code"], "period_utc", 500).groupBy("ba_code", "_piece").count().collect()
    assert max(r["count"] for r in sizes) <= 510 and sum(r["count"] for r in sizes) == 12_000
    units = windows.with_units(busy, ["ba_code"], "period_utc", 500).groupBy("ba_code", "_unit").count().collect()
    assert max(r["count"] for r in units) <= 300
    got = windows.number_rows(busy, ["ba_code"], "period_utc", "n", piece=500)
    same(got, busy.withColumn("n", F.row_number().over(plain())), ["n"])
    got = windows.rolling(busy, ["ba_code"], "period_utc", "v", "avg", 24, 1, 0, "r", block_rows=700, piece=500)
    same(got, busy.withColumn("r", F.avg("v").over(plain().rowsBetween(-23, 0))), ["r"])
    got = windows.fill(busy, ["ba_code"], "period_utc", "v", "f", 500)
    same(got, busy.withColumn("v", F.last("v", True).over(plain().rowsBetween(W.unboundedPreceding, 0))), ["v"])
