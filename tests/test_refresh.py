"""Rollups that follow logged changes, and swaps of several tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from hourlake.operators import refresh, rollups, upkeep

T0 = dt.datetime(2026, 1, 1)
KEYS = ["period_utc", "ba_code"]
SCHEMA = "period_utc timestamp_ntz, ba_code string, value_mwh double, series string"


def rows(hours, value=1.0, keys=("a", "b")):
    return [(T0 + dt.timedelta(hours=h), k, value + h, "D") for h in hours for k in keys]


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def stored(spark, frame, tmp_path):
    rollup = refresh.Rollup(str(tmp_path / "daily"), str(tmp_path / "log"), "1 day", ("ba_code",), 168, 6, where="series = 'D'")
    path = str(tmp_path / "facts")
    upkeep.upsert(frame(rows(range(240)), SCHEMA), path, KEYS, logs=[rollup.log])
    return path, rollup, T0 + dt.timedelta(hours=240)


def full(spark, path, rollup, until):
    days = rollup.of(spark.read.parquet(path)).where(F.col("bucket_utc") < F.lit(until))
    return table(days.select("bucket_utc", "ba_code", "avg_mwh", "peak_mwh", "trough_mwh", "n_obs"))


def kept(spark, rollup):
    return table(refresh.read_rollup(spark, rollup).select("bucket_utc", "ba_code", "avg_mwh", "peak_mwh", "trough_mwh", "n_obs"))


def test_a_late_revision_reaches_its_bucket_only(spark, frame, stored, monkeypatch):
    path, rollup, now = stored
    every = refresh.Rollup(rollup.path, rollup.log, "1 day", ("ba_code",), None, None, where="series = 'D'")
    assert refresh.refresh(spark, path, every, now) == 20
    assert kept(spark, rollup) == full(spark, path, rollup, now)
    opened = []
    real = refresh.facts_of

    def watched(*args):
        out = real(*args)
        plan = out._jdf.queryExecution().executedPlan().toString()
        opened.extend(re.findall(r"PartitionFilters: \[[^\]]*d#\d+ = ([0-9-]+)\)", plan) or [plan])
        return out

    monkeypatch.setattr(refresh, "facts_of", watched)
    old = {p: s for p, s in files(rollup.path)}
    revised = frame([(T0 + dt.timedelta(hours=5 * 24 + 3), "a", 777.0, "D")], SCHEMA)
    upkeep.upsert(revised, path, KEYS, logs=[rollup.log])
    assert refresh.refresh(spark, path, rollup, now) == 1
    assert kept(spark, rollup) == full(spark, path, rollup, now)
    assert set(opened) == {"2026-01-06"}
    new = {p: s for p, s in files(rollup.path)}
    assert {p for p in old if "d=2026-01-06" not in p} == {p for p in new if "d=2026-01-06" not in p}
    assert refresh.refresh(spark, path, rollup, now) == 0 and refresh.log_batches(spark, rollup.log) == []


def files(path):
    from pathlib import Path

    return [(str(p), p.stat().st_size) for p in Path(path).rglob("*.parquet")]


def test_entries_outside_the_ages_wait(spark, frame, stored):
    path, rollup, now = stored
    assert refresh.refresh(spark, path, rollup, now) == 12  # seven whole days, the last of them not settled yet
    days = {r[0] for r in kept(spark, rollup)}
    assert days == {T0 + dt.timedelta(days=d) for d in range(3, 9)}
    assert refresh.refresh(spark, path, rollup, now) == 0
    assert refresh.refresh(spark, path, rollup, now + dt.timedelta(hours=6)) == 2
    every = refresh.Rollup(rollup.path, rollup.log, "1 day", ("ba_code",), None, None, where="series = 'D'")
    assert refresh.refresh(spark, path, every) == 6
    assert kept(spark, rollup) == full(spark, path, rollup, now)


def test_what_did_not_change_is_neither_logged_nor_rewritten(spark, frame, stored):
    path, rollup, now = stored
    every = refresh.Rollup(rollup.path, rollup.log, "1 day", ("ba_code",), None, None, where="series = 'D'")
    refresh.refresh(spark, path, every, now)
    before = files(path)
    upkeep.upsert(frame(rows(range(240)), SCHEMA), path, KEYS, logs=[rollup.log])
    assert files(path) == before and refresh.log_batches(spark, rollup.log) == []
    mixed = rows(range(239)) + [(T0 + dt.timedelta(hours=239), "a", None, "D")]
    assert upkeep.upsert(frame(mixed, SCHEMA), path, KEYS, logs=[rollup.log]) == 479
    assert sum(a != b for a, b in zip(sorted(files(path)), sorted(before))) >= 1
    assert [r["ba_code"] for r in spark.read.parquet(*refresh.log_batches(spark, rollup.log)).collect()] == ["a"]


def test_deleted_facts_leave_the_rollup(spark, stored):
    path, rollup, now = stored
    every = refresh.Rollup(rollup.path, rollup.log, "1 day", ("ba_code",), None, None, where="series = 'D'")
    refresh.refresh(spark, path, every, now)
    day = F.col("d") == F.lit(dt.date(2026, 1, 4))
    assert upkeep.purge(spark, path, day | ((F.col("ba_code") == "b") & (F.col("d") == F.lit(dt.date(2026, 1, 5)))), logs=[rollup.log], keys=KEYS) == 72
    assert refresh.refresh(spark, path, every, now) == 3
    assert kept(spark, rollup) == full(spark, path, rollup, now) and len(kept(spark, rollup)) == 17
    assert dt.date(2026, 1, 4) not in upkeep.stored_dates(spark, rollup.path)


def test_a_run_lost_before_the_log_is_cleared_repeats_the_same_buckets(spark, frame, stored, monkeypatch):
    path, rollup, now = stored
    every = refresh.Rollup(rollup.path, rollup.log, "1 day", ("ba_code",), None, None, where="series = 'D'")
    with monkeypatch.context() as m:
        m.setattr(refresh, "log_batches", lambda s, log: [f for f in [*real_batches(s, log)]])
        m.setattr(upkeep, "remove_folder", _fail_on_batches)
        with pytest.raises(OSError):
            refresh.refresh(spark, path, every, now)
    assert refresh.refresh(spark, path, every, now) == 20
    assert kept(spark, rollup) == full(spark, path, rollup, now)


real_batches, real_remove = refresh.log_batches, upkeep.remove_folder


def _fail_on_batches(spark, path):
    if "/batch=" in path:
        raise OSError("lost")
    real_remove(spark, path)


def test_facts_without_a_log_can_be_noted_afterwards(spark, frame, tmp_path):
    path = str(tmp_path / "facts")
    upkeep.upsert(frame(rows(range(50)), SCHEMA), path, KEYS)
    rollup = refresh.Rollup(str(tmp_path / "hourly"), str(tmp_path / "log"), "1 hour", ("ba_code",), None, None, total=True)
    assert refresh.refresh(spark, path, rollup) == 0 and not upkeep.exists(spark, rollup.path)
    refresh.invalidate(spark.read.parquet(path).where("period_utc < '2026-01-02'"), rollup)
    assert refresh.refresh(spark, path, rollup) == 48
    want = rollups.rollup_sum(frame(rows(range(24)), SCHEMA), "1 hour", ["ba_code"])
    assert table(refresh.read_rollup(spark, rollup).select(want.columns)) == table(want)


def test_a_marker_that_is_there_already_is_an_error_and_loses_nothing(spark, frame, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    upkeep.upsert(frame(rows(range(3)), SCHEMA), path, KEYS)
    with monkeypatch.context() as m:
        m.setattr(upkeep, "recover", lambda *_: False)
        upkeep.upsert(frame(rows(range(3), 10.0), SCHEMA), path, KEYS)
        with pytest.raises(OSError, match="another swap is pending"):
            upkeep.upsert(frame(rows(range(3), 20.0), SCHEMA), path, KEYS)
    assert upkeep.recover(spark, path)
    assert sorted(r["value_mwh"] for r in spark.read.parquet(path).collect()) == [10.0, 10.0, 11.0, 11.0, 12.0, 12.0]
    assert upkeep.upsert(frame(rows(range(3), 20.0), SCHEMA), path, KEYS) == 6


def test_appending_nothing_gives_zero(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    assert upkeep.append_rows(frame([], SCHEMA), path) == 0
    assert upkeep.append_rows(spark.createDataFrame([], SCHEMA), path) == 0
    assert upkeep.append_rows(frame(rows(range(2)), SCHEMA), path) == 4
    assert upkeep.append_rows(frame(rows(range(2)), SCHEMA).where("value_mwh > 100"), path) == 0


def test_loads_that_end_together_are_both_there(spark, frame, tmp_path):
    path, at = str(tmp_path / "fresh"), dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    target = frame(rows(range(3)), SCHEMA)
    upkeep.update_freshness(path, "a", target, 5, at)
    upkeep.update_freshness(path, "b", target, 6, at)
    upkeep.freshness_error(spark, path, "b", "down", at + dt.timedelta(hours=1))
    upkeep.freshness_error(spark, path, "c", "never up", at)

    def seen():
        return sorted((r["source"], r["last_rows"], r["last_error"], r["last_fetch_utc"] is None) for r in upkeep.read_freshness(spark, path).collect())

    want = [("a", 5, None, False), ("b", 6, "down", False), ("c", None, "never up", True)]
    assert seen() == want
    upkeep.update_freshness(path, "b", target, 7, at + dt.timedelta(hours=2))
    upkeep.compact_freshness(spark, path)
    assert seen() == [want[0], ("b", 7, None, False), want[2]] and spark.read.parquet(path).count() == 4


# --- tables that lie alike, tables that change together ----------------------------------------


def test_equal_buckets_join_without_a_shuffle(spark, frame, tmp_path):
    from hourlake.operators import joins

    buckets = upkeep.Buckets(4, ("period_utc", "ba_code"))
    demand, forecast = str(tmp_path / "demand"), str(tmp_path / "forecast")
    for path, hours in ((demand, range(0, 60)), (forecast, range(10, 70)), (demand, range(20, 80))):
        upkeep.upsert(frame(rows(hours, 5.0 if hours.start == 20 else 1.0), SCHEMA), path, KEYS, buckets=buckets)
    d = upkeep.read_buckets(spark, demand, buckets).withColumnRenamed("value_mwh", "demand_mwh")
    f = upkeep.read_buckets(spark, forecast, buckets).withColumnRenamed("value_mwh", "forecast_mwh")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.demand_with_forecast(d, f)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = table(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    plain = joins.demand_with_forecast(
        spark.read.parquet(demand).withColumnRenamed("value_mwh", "demand_mwh"), spark.read.parquet(forecast).withColumnRenamed("value_mwh", "forecast_mwh")
    )
    assert got == table(plain) and len(got) == 160
    assert {r[2] for r in got if r[0] == T0 + dt.timedelta(hours=20)} == {25.0}


def swaps_of(frame, tmp_path, value):
    return [upkeep.stage(frame(rows(range(5), value + i), SCHEMA), str(tmp_path / f"t{i}"), None, whole=True) for i in range(3)]


def values(spark, tmp_path):
    return [spark.read.parquet(str(tmp_path / f"t{i}")).agg(F.min("value_mwh")).first()[0] for i in range(3)]


@pytest.mark.parametrize("done", [0, 1, 2, 3])
def test_several_tables_change_together(spark, frame, tmp_path, monkeypatch, done):
    upkeep.commit(spark, swaps_of(frame, tmp_path, 10.0))
    assert values(spark, tmp_path) == [10.0, 11.0, 12.0]
    second = swaps_of(frame, tmp_path, 20.0)
    with monkeypatch.context() as m:
        m.setattr(upkeep, "recover", lambda *_: False)  # the driver is lost once the swaps are booked
        upkeep.commit(spark, second)
    assert values(spark, tmp_path) == [10.0, 11.0, 12.0]
    for swap in second[:done]:
        upkeep.remove_folder(spark, swap.path)
        upkeep._folder(spark, swap.staged)[0].rename(*(spark._jvm.org.apache.hadoop.fs.Path(p) for p in (swap.staged, swap.path)))
    assert upkeep.recover(spark, str(tmp_path / "t1")) and values(spark, tmp_path) == [20.0, 21.0, 22.0]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["t0", "t1", "t2"]


def test_one_table_of_a_swap_that_is_pending_stops_all(spark, frame, tmp_path, monkeypatch):
    upkeep.commit(spark, swaps_of(frame, tmp_path, 10.0))
    with monkeypatch.context() as m:
        m.setattr(upkeep, "recover", lambda *_: False)
        upkeep.overwrite_table(frame(rows(range(5), 50.0), SCHEMA), str(tmp_path / "t2"))
        with pytest.raises(OSError, match="pending"):
            upkeep.commit(spark, swaps_of(frame, tmp_path, 20.0))
    upkeep.recover(spark, str(tmp_path / "t2"))
    assert values(spark, tmp_path) == [10.0, 11.0, 50.0]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["t0", "t1", "t2"]
    with pytest.raises(ValueError, match="share a folder"):
        upkeep.commit(spark, [upkeep.Swap("a", str(tmp_path / "x" / "t"), True), upkeep.Swap("b", str(tmp_path / "t"), True)])
