import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourlake.operators import filters, upkeep
from hourlake.session import shared_dir
from hourlake.streaming import rollups as streams

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "period_utc timestamp_ntz, ba_code string, value_mwh double, source string"
KEYS = ["period_utc", "ba_code"]


def rows(first, last, value=1.0, source="EIA"):
    return [(T0 + dt.timedelta(hours=h), k, value, source) for h in range(first, last) for k in ("a", "b")]


def content(spark, path):
    return sorted((r.period_utc, r.ba_code, r.value_mwh) for r in spark.read.parquet(path).collect())


def test_upsert_twice_equals_once(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    assert upkeep.upsert(frame(rows(0, 60), SCHEMA), path, KEYS) == 120
    untouched = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "d=2026-01-01").iterdir()}
    batch = frame(rows(50, 70, 2.0), SCHEMA)
    assert upkeep.upsert(batch, path, KEYS) == 40
    once = content(spark, path)
    upkeep.upsert(batch, path, KEYS)
    assert content(spark, path) == once
    assert len(once) == 140 and sum(v for *_, v in once) == 100 + 80
    assert untouched == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "d=2026-01-01").iterdir()}
    assert upkeep.upsert(batch.limit(0), path, KEYS) == 0 and content(spark, path) == once


def test_empty_first_batch_leaves_no_table(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    assert upkeep.upsert(frame([], SCHEMA), path, KEYS) == 0
    assert not upkeep.exists(spark, path)


def test_last_row_of_a_key_wins(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    twice = frame([(T0, "a", 1.0, 1), (T0, "a", 9.0, 3), (T0, "a", 5.0, 2)], "period_utc timestamp_ntz, ba_code string, value_mwh double, n int")
    upkeep.upsert(twice, path, KEYS, order_col="n")
    assert content(spark, path) == [(T0, "a", 9.0)]


def test_incremental_equals_full_when_nothing_is_older(spark, frame, tmp_path):
    inc, full = str(tmp_path / "inc"), str(tmp_path / "full")
    upkeep.refresh_mart(frame(rows(0, 100), SCHEMA), inc, KEYS)
    later = frame(rows(0, 70) + rows(70, 130, 3.0), SCHEMA)
    upkeep.refresh_mart(later, inc, KEYS)
    upkeep.refresh_mart(later, full, KEYS)
    assert content(spark, inc) == content(spark, full)
    old_change = frame(rows(0, 10, 7.0) + rows(10, 130, 3.0), SCHEMA)
    upkeep.refresh_mart(old_change, inc, KEYS)
    assert content(spark, inc)[0][2] == 1.0


def test_purge_and_retention(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    upkeep.append_rows(frame(rows(0, 30) + rows(24, 72, 5.0, "DEMO"), SCHEMA), path)
    assert upkeep.purge(spark, path, F.col("source") == "DEMO") == 96
    assert len(content(spark, path)) == 60
    assert upkeep.stored_dates(spark, path) == [dt.date(2026, 1, 1), dt.date(2026, 1, 2)]
    assert upkeep.retain(spark, path, dt.date(2026, 1, 3), days=1) == [dt.date(2026, 1, 1)]
    assert len(content(spark, path)) == 12


def test_month_partitions(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    upkeep.upsert(frame(rows(0, 1000), SCHEMA), path, KEYS, grain="month")
    assert upkeep.stored_dates(spark, path, "m") == [dt.date(2026, 1, 1), dt.date(2026, 2, 1)]
    upkeep.refresh_mart(frame(rows(990, 1010, 2.0), SCHEMA), path, KEYS, grain="month")
    assert len(content(spark, path)) == 2020
    assert upkeep.retain(spark, path, dt.date(2026, 2, 10), days=10, date_col="m") == []
    assert upkeep.retain(spark, path, dt.date(2026, 2, 11), days=10, date_col="m") == [dt.date(2026, 1, 1)]


def test_trailing_window_opens_only_its_days(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    upkeep.append_rows(frame(rows(0, 240), SCHEMA), path)
    table = spark.read.parquet(path)
    for df, n in ((filters.trailing(table, "period_utc", 24), 48), (filters.settled(table, "period_utc", None, 72, 3), 138)):
        assert df.count() == n
        parts = df.select(F.input_file_name().alias("f")).distinct().count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(d" in plan and parts <= 4


def test_error_keeps_the_last_fetch(spark, frame, tmp_path):
    ops, path = str(tmp_path / "ops"), str(tmp_path / "t")
    clock = iter(dt.datetime(2026, 1, 5, h, tzinfo=dt.timezone.utc) for h in range(10))

    def good():
        return upkeep.upsert(frame(rows(0, 5), SCHEMA), path, KEYS), spark.read.parquet(path)

    def bad():
        raise RuntimeError("x" * 900)

    def latest():
        return upkeep.read_freshness(spark, f"{ops}/source_freshness").first()

    assert upkeep.run_source(spark, ops, "S", good, lambda: next(clock)) == 10
    first = latest()
    assert first.last_error is None and first.last_rows == 10
    assert upkeep.run_source(spark, ops, "S", bad, lambda: next(clock)) == 0
    second = latest()
    assert len(second.last_error) == 500 and second.last_fetch_utc == first.last_fetch_utc and second.last_rows == 10
    assert upkeep.run_source(spark, ops, "S", good, lambda: next(clock)) == 10
    assert latest().last_error is None
    runs = spark.read.parquet(f"{ops}/ingest_run").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in runs} == {"ok": 2, "error": 1}


# --- nothing lost, nothing left to chance ------------------------------------------------------


def test_null_keys_are_refused_and_nothing_is_written(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    upkeep.upsert(frame(rows(0, 5), SCHEMA), path, KEYS)
    before = content(spark, path)
    with pytest.raises(ValueError, match="1 rows have a null"):
        upkeep.upsert(frame([(None, "z", 1.0, "EIA"), (T0, "a", 7.0, "EIA")], SCHEMA), path, KEYS)
    assert content(spark, path) == before and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ValueError, match="time column"):
        upkeep.upsert(frame(rows(0, 5), SCHEMA), path, ["ba_code"])


def test_ties_are_decided_by_all_columns(spark, frame, tmp_path):
    tied = [(T0, "a", float(v), s) for v, s in ((1, "x"), (3, "b"), (3, "c"), (2, "z"))]
    for i, batch in enumerate((tied, tied[::-1])):
        path = str(tmp_path / f"t{i}")
        upkeep.upsert(frame(batch, SCHEMA).repartition(3), path, KEYS)
        assert [tuple(r) for r in spark.read.parquet(path).select("value_mwh", "source").collect()] == [(3.0, "c")]


def test_purge_reaches_rows_without_a_date(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    upkeep.append_rows(frame([*rows(0, 2), (None, "a", 1.0, "DEMO"), (None, "b", 2.0, "EIA")], SCHEMA), path)
    assert upkeep.purge(spark, path, F.col("source") == "DEMO") == 1
    assert spark.read.parquet(path).where("period_utc IS NULL").count() == 1
    assert upkeep.purge(spark, path, F.col("period_utc").isNull()) == 1
    assert spark.read.parquet(path).count() == 4 and upkeep.stored_dates(spark, path) == [dt.date(2026, 1, 1)]


@pytest.mark.parametrize("done", [0, 1])
def test_a_swap_cut_in_half_is_finished(spark, frame, tmp_path, monkeypatch, done):
    path = str(tmp_path / "t")
    upkeep.upsert(frame(rows(0, 48), SCHEMA), path, KEYS)
    monkeypatch.setattr(upkeep, "recover", lambda *_: False)  # the driver is lost once the swap is booked
    upkeep.upsert(frame(rows(0, 48, 2.0), SCHEMA), path, KEYS)
    monkeypatch.undo()
    assert sum(v for *_, v in content(spark, path)) == 96
    if done:
        staged = next(p for p in tmp_path.iterdir() if ".staged-" in p.name)
        upkeep.remove_folder(spark, f"{path}/d=2026-01-01")
        (staged / "d=2026-01-01").rename(tmp_path / "t" / "d=2026-01-01")
    upkeep.upsert(frame(rows(48, 49), SCHEMA), path, KEYS)
    assert sum(v for *_, v in content(spark, path)) == 2 * 96 + 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["t"]


def test_overwrite_keeps_the_old_table_until_the_new_one_is_there(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    upkeep.overwrite_table(frame(rows(0, 3), SCHEMA), path)
    with pytest.raises(Exception):
        upkeep.overwrite_table(frame(rows(0, 3), SCHEMA).withColumn("x", F.raise_error(F.lit("lost"))), path)
    assert spark.read.parquet(path).count() == 6
    upkeep.overwrite_table(frame(rows(0, 30), SCHEMA), path, "period_utc")
    upkeep.overwrite_table(frame(rows(40, 41), SCHEMA), path, "period_utc")
    assert upkeep.stored_dates(spark, path) == [dt.date(2026, 1, 2)]


def test_windows_on_stored_tables_are_pruned(spark, frame, tmp_path):
    for grain, name in (("day", "d"), ("month", "m")):
        path = str(tmp_path / grain)
        upkeep.upsert(frame(rows(0, 1500), SCHEMA), path, KEYS, grain=grain)
        table = spark.read.parquet(path)
        for df in (filters.trailing(table, "period_utc", 24, T0 + dt.timedelta(hours=1400)), upkeep.since(table, T0 + dt.timedelta(hours=1400))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            filter_text = plan.split("PartitionFilters: [")[1].split("]")[0]
            assert f"{name}#" in filter_text
            files = df.select(F.input_file_name()).distinct().count()
            assert files < table.select(F.input_file_name()).distinct().count()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: None)})
        sparkContext = Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(Session, "x")
    Session.conf = type("C", (), {"get": staticmethod(lambda k, d: "hdfs:///shared/")})
    assert shared_dir(Session, "x").startswith("hdfs:///shared/x-")


# --- streams ----------------------------------------------------------------------------------

FEED = "id long, period_utc timestamp, ba_code string, value_mwh double"


def land(spark, folder, data):
    spark.createDataFrame(data, FEED).coalesce(1).write.mode("append").parquet(folder)


def feed(spark, folder):
    schema = spark.createDataFrame([], FEED).schema
    return streams.read_feed(spark, folder, schema, max_files=1)


def minute(m):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)


def test_late_rows_count_until_the_watermark(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))

    def run():
        streams.stream_to_table(streams.stream_rollup(feed(spark, src), "1 hour", "1 hour", ["ba_code"]), out, chk)

    land(spark, src, [(1, minute(10), "a", 1.0), (2, minute(100), "a", 5.0)])
    run()
    land(spark, src, [(3, minute(50), "a", 3.0)])  # within the watermark
    run()
    land(spark, src, [(4, minute(400), "a", 1.0)])  # closes the first hours
    run()
    land(spark, src, [(5, minute(20), "a", 99.0)])  # too late
    run()
    got = {r.bucket_utc.hour: (r.avg_mwh, r.n_obs) for r in spark.read.parquet(out).collect()}
    assert got == {0: (2.0, 2), 1: (5.0, 1)}


def test_replay_and_revision(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    keys = ["period_utc", "ba_code"]
    land(spark, src, [(1, minute(0), "a", 1.0), (2, minute(60), "a", 2.0)])
    streams.stream_upsert(feed(spark, src), out, keys, order_col="id", checkpoint=chk)
    land(spark, src, [(1, minute(0), "a", 1.0), (3, minute(60), "a", 8.0)])
    streams.stream_upsert(feed(spark, src), out, keys, order_col="id", checkpoint=chk)
    streams.stream_upsert(feed(spark, src).where("id > 0"), out, keys, str(tmp_path / "other"), order_col="id")
    assert sorted((r.period_utc.hour, r.value_mwh) for r in spark.read.parquet(out).collect()) == [(0, 1.0), (1, 8.0)]


@pytest.mark.parametrize("width", ["1 hour", "1 day"])
def test_stream_equals_batch(spark, sf_dir, tmp_path, width):
    from hourlake.operators import rollups as batch

    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS id", "CAST(ts AS timestamp) AS period_utc", "event_type AS ba_code", "value AS value_mwh"
    )
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    events.coalesce(1).write.parquet(src)
    live = streams.stream_rollup(feed(spark, src), width, "1 hour", ["ba_code"])
    streams.stream_upsert(live, out, ["bucket_utc", "ba_code"], str(tmp_path / "chk"), time_col="bucket_utc", output_mode="update")
    want = batch.rollup(events, width, ["ba_code"]).selectExpr("bucket_utc", "ba_code", "n_obs", "round(avg_mwh, 6) AS a")
    got = spark.read.parquet(out).selectExpr("bucket_utc", "ba_code", "n_obs", "round(avg_mwh, 6) AS a")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_restart_repeats_and_loses_nothing(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    for i in range(3):
        land(spark, src, [(i, minute(60 * i), "a", 1.0)])
        streams.stream_to_table(feed(spark, src), out, chk)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    with pytest.raises(TypeError):
        streams.stream_to_table(feed(spark, src), out)


def test_late_rows_are_counted(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    seen = []
    for m in (60 * 100, 60 * 99, 60 * 10, 60 * 101):
        land(spark, src, [(m, minute(m), "a", 1.0)])
        streams.stream_incremental(feed(spark, src), out, ["period_utc", "ba_code"], chk, on_late=seen.append)
    assert seen == [0, 0, 1, 0] and spark.read.parquet(out).count() == 3
