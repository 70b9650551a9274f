"""Sketches, revision state, chained streams, drifting payloads, gaps, ARMA and the export run."""

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from hourlake.operators import arma, filters, forecast, quality, refresh, sketches, upkeep
from hourlake.sources import drift, tables
from hourlake.streaming import chains, revisions, rollups

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "period_utc timestamp_ntz, ba_code string, value_mwh double"


def at(h):
    return T0 + dt.timedelta(hours=h)


# --- sketches ---------------------------------------------------------------------------------


def test_quantiles_of_long_windows_stay_within_the_rank_error(spark):
    n = 60_000
    df = spark.range(n).selectExpr(
        "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, 0, id * 40) AS period_utc", "IF(id % 50 = 0, 'thin', 'hot') AS ba_code", "CAST(hash(id) % 100000 AS DOUBLE) AS value_mwh"
    )
    rollup = sketches.sketch_rollup(df, "1 day", ["ba_code"])
    got = {r["ba_code"]: r for r in sketches.window_quantiles(rollup, ["ba_code"], {"p50": 0.5, "p95": 0.95}, 720).collect()}
    for key in ("hot", "thin"):
        values = np.sort([r[0] for r in df.where(F.col("ba_code") == key).select("value_mwh").collect()])
        assert got[key]["n_obs"] == len(values) and got[key]["peak"] == values[-1] and got[key]["trough"] == values[0]
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            low, high = np.searchsorted(values, got[key][name], "left") / len(values), np.searchsorted(values, got[key][name], "right") / len(values)
            assert low - sketches.rank_error() <= q <= high + sketches.rank_error()


# --- revisions --------------------------------------------------------------------------------

REVISED = "period_utc timestamp, ba_code string, seen int, value_mwh double, source string"


@pytest.mark.parametrize("source", ["EIA", None])
def test_only_real_changes_pass(spark, tmp_path, source):
    landed, path, checkpoint = (str(tmp_path / n) for n in ("landed", "table", "checkpoint"))
    log = str(tmp_path / "log")
    batches = [
        [(0, "a", 1, 10.0), (0, "a", 3, 30.0), (0, "b", 1, 5.0), (30, "a", 1, 7.0)],
        [(0, "a", 2, 20.0), (0, "b", 1, 5.0), (30, "a", 2, 7.0)],  # older, a replay, newer without a new value
        [(0, "a", 4, 40.0), (30, "b", 1, None)],
    ]
    seen, before = [], None
    for i, batch in enumerate(batches):
        rows = [(at(h), k, n, v, source) for h, k, n, v in batch]
        spark.createDataFrame(rows, REVISED).coalesce(1).write.mode("append").parquet(landed)
        feed = rollups.read_feed(spark, landed, spark.read.parquet(landed).schema, max_files=1)
        revisions.stream_latest(feed, path, ["period_utc", "ba_code"], "seen", checkpoint, "10 days", logs=[log])  # restarts each time
        files = sorted(str(p) for p in Path(path).rglob("*.parquet"))
        seen.append(files == before)
        before = files
    assert seen == [False, True, False]
    got = {(r["period_utc"], r["ba_code"]): (r["seen"], r["value_mwh"]) for r in spark.read.parquet(path).collect()}
    assert got == {(at(0), "a"): (4, 40.0), (at(0), "b"): (1, 5.0), (at(30), "a"): (1, 7.0), (at(30), "b"): (1, None)}
    assert len(refresh.log_batches(spark, log)) == 2


def test_state_ends_with_the_watermark(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    for rows in ([(0, "a", 1, 1.0)], [(200, "a", 1, 2.0)], [(201, "a", 1, 3.0), (0, "a", 2, 9.0)]):
        spark.createDataFrame([(at(h), k, n, v, "x") for h, k, n, v in rows], REVISED).coalesce(1).write.mode("append").parquet(landed)
        feed = rollups.read_feed(spark, landed, spark.read.parquet(landed).schema, max_files=1)
        changes = revisions.latest_revisions(feed, ["period_utc", "ba_code"], "seen", "24 hours")
        writer = changes.writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(out))
        rollups.run_stream(writer.option("checkpointLocation", str(tmp_path / "checkpoint")))
    got = sorted((r["period_utc"], r["value_mwh"], r["change"]) for r in spark.read.parquet(out).collect())
    assert got == [(at(0), 1.0, "insert"), (at(200), 2.0, "insert"), (at(201), 3.0, "insert")]


# --- chains -----------------------------------------------------------------------------------


def test_a_chain_gives_the_batch_result_across_a_restart(spark, tmp_path):
    landed = str(tmp_path / "landed")
    levels = [chains.Level(w, late, str(tmp_path / n), str(tmp_path / f"c-{n}")) for n, w, late in (("hour", "1 hour", "1 hour"), ("day", "1 day", "6 hours"))]
    for start in (0, 60):
        rows = [(at(h) + dt.timedelta(minutes=m), k, float(h + m)) for h in range(start, start + 60) for m in (0, 20, 50) for k in ("a", "b") if h % 5 or k == "a"]
        spark.createDataFrame(rows, "period_utc timestamp, ba_code string, value_mwh double").coalesce(1).write.mode("append").parquet(landed)
        chains.run_chain(rollups.read_feed(spark, landed, spark.read.parquet(landed).schema), levels, ["ba_code"])
    days = {(r["bucket_utc"], r["ba_code"]): r for r in chains.with_means(spark.read.parquet(levels[1].path)).collect()}
    plain = spark.read.parquet(landed).groupBy(F.window("period_utc", "1 day")["start"].alias("t"), "ba_code")
    want = {(r["t"], r["ba_code"]): r for r in plain.agg(F.avg("value_mwh").alias("avg"), F.count("*").alias("n"), F.max("value_mwh").alias("peak")).collect()}
    assert set(days) == {k for k in want if k[0] < at(96)} and len(days) == 8
    assert all((d["n_obs"], d["peak"]) == (want[k]["n"], want[k]["peak"]) and d["avg"] == pytest.approx(want[k]["avg"]) for k, d in days.items())
    hours = spark.read.parquet(levels[0].path)
    assert hours.count() == hours.select("bucket_utc", "ba_code").distinct().count()


# --- drift ------------------------------------------------------------------------------------

DECLARED = T.StructType().add("id", T.LongType()).add("v", T.DoubleType()).add("site", T.StructType().add("zone", T.StringType()))


def test_nothing_of_a_drifting_source_is_lost(spark, tmp_path):
    lines = {
        "plain": ['{"id": 1, "v": 1.5, "site": {"zone": "x"}}', '{"id": 2, "v": null}', ""],
        "added": ['{"id": 3, "v": 2, "extra": {"deep": [7]}}'],
        "changed": ['{"id": "four", "v": "n/a", "site": "x"}', '{"id": "5", "v": "6.5"}'],
        "broken": ['{"id": 6,', "[1, 2]", "null", "7", "not json at all"],
    }
    for name, text in lines.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(text))
    parsed = drift.parse_records(drift.read_records(spark, str(tmp_path / "in")), DECLARED)
    parsed.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    good, bad = drift.split_broken(stored)
    rows = {r["id"]: r for r in good.collect()}
    assert good.count() == 5 and (rows[1]["v"], rows[1]["site"]["zone"], rows[2]["v"], rows[2]["drifted"]) == (1.5, "x", None, [])
    assert rows[5]["v"] == 6.5 and rows[5]["drifted"] == [] and rows[None]["drifted"] == ["id", "v", "site"]
    deep = good.select(drift.field("extra.deep", "array<int>").alias("d"), drift.present("extra").alias("p")).where("p").collect()
    assert [r["d"] for r in deep] == [[7]]
    assert good.where("id IS NULL").select(drift.field("id", "string").alias("s")).first()["s"] == "four"
    assert sorted((Path(r["file"]).stem, r["line"], r["reason"]) for r in bad.collect()) == [
        ("broken", "7", "not an object"), ("broken", "[1, 2]", "not an object"), ("broken", "not json at all", "not json"),
        ("broken", "null", "not an object"), ("broken", '{"id": 6,', "not json"),
    ]
    report = {(Path(r["file"]).stem, r["reason"]): r["n"] for r in drift.drift_report(stored).collect()}
    assert report[("changed", "type of id")] == 1 and report[("plain", "ok")] == 2 and report[("broken", "not json")] == 2


# --- gaps -------------------------------------------------------------------------------------


def stored(frame, hours, key="a"):
    return [(at(h), key, 1.0) for h in hours]


def test_holes_in_the_middle_at_both_ends_and_beyond_a_week(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    rows = stored(frame, [h for h in range(5, 500) if h not in (7, 8, 20) and not 100 <= h < 300]) + stored(frame, [0, 499], "b")
    upkeep.append_rows(frame(rows + rows[:3], SCHEMA), path)
    expected = frame([("a",), ("b",), ("c",)], "ba_code string")
    df = spark.read.parquet(path)
    got = sorted((r["ba_code"], r["from_utc"], r["to_utc"], r["hours"]) for r in tables.missing_ranges(df, ["ba_code"], T0, at(504), expected).collect())
    spans = [("a", 0, 5), ("a", 7, 9), ("a", 20, 21), ("a", 100, 300), ("a", 500, 504), ("b", 1, 499), ("b", 500, 504), ("c", 0, 504)]
    assert got == [(k, at(x), at(y), y - x) for k, x, y in spans]
    known = sorted(r["ba_code"] for r in tables.missing_ranges(df, ["ba_code"], T0, at(504)).select("ba_code").distinct().collect())
    assert known == ["a", "b"]
    holes = tables.missing_ranges(df, ["ba_code"], T0, at(504), expected.where("ba_code = 'a'"))
    ranges = sorted((r["from_utc"], r["to_utc"], r["holes"]) for r in tables.fetch_ranges(holes, ["ba_code"], 11, 3).collect())
    assert ranges == [(at(-3), at(21), 3), (at(97), at(300), 1), (at(497), at(504), 1)]
    assert tables.missing_ranges(df.limit(0), ["ba_code"], T0, at(5), expected).count() == 3
    plan = tables.missing_ranges(df, ["ba_code"], at(48), at(72))._jdf.queryExecution().executedPlan().toString()
    assert "d#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_the_next_load_looks_at_the_newest_partitions_only(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    upkeep.append_rows(frame(stored(frame, range(0, 900, 7)) + stored(frame, [3], "b"), SCHEMA), path)
    whole = tables.catchup_start(spark.read.parquet(path), at(900)).first()
    pruned = tables.catchup_start(path, at(900), spark=spark)
    assert whole == pruned.first() and "PartitionFilters: [isnotnull(d" in pruned._jdf.queryExecution().executedPlan().toString()
    late = tables.catchup_start(path, at(900), key_filter=F.col("ba_code") == "b", spark=spark).first()
    assert late["start_utc"] == at(900 - 168) and late["last_period_utc"] is None


# --- per-key windows, sources, report ---------------------------------------------------------


def test_last_hours_per_key_from_the_newest_days_first(spark, frame):
    rows = stored(frame, range(900)) + stored(frame, range(0, 700), "b") + stored(frame, [10, 11, 40], "c")
    df = frame(rows, SCHEMA)
    for as_of, keys in ((at(899), None), (at(899), frame([("a",), ("b",), ("c",), ("d",)], "ba_code string")), (at(650), None)):
        got = filters.trailing_per_key(df, "period_utc", 24, "ba_code", as_of, keys, 48)
        want = filters.trailing_per_key(df.where(F.col("period_utc") <= F.lit(as_of)), "period_utc", 24, "ba_code")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 24


def test_rows_of_one_source_are_chosen_alike_however_they_are_dealt(spark, frame):
    rows = [(T0, "a", float(i % 2), "EIA", {"m": i}) for i in range(40)] + [(T0, "a", 9.0, "NOAA", {})]
    for n in (1, 3, 7):
        df = frame(rows, f"{SCHEMA}, source string, note map<string,int>").repartition(n)
        assert [r["value_mwh"] for r in quality.resolve_source(df, ["period_utc", "ba_code"], ["EIA"]).collect()] == [1.0]


def test_the_report_reads_demand_once(spark, frame, tmp_path):
    path, gen = str(tmp_path / "d"), str(tmp_path / "g")
    rows = [(at(h), k, s, v) for h in range(200) for k in "ab" for s, v in (("D", 10.0), ("NG", 12.0), ("TI", 2.0 if k == "a" else 9.0))]
    upkeep.append_rows(frame([*rows, (at(199), "a", "D", -1.0), (at(198), "b", "D", None)], "period_utc timestamp_ntz, ba_code string, series string, value_mwh double"), path)
    upkeep.append_rows(frame([(at(h), "a", f, 6.0) for h in range(200) for f in ("COL", "NG")], "period_utc timestamp_ntz, ba_code string, fuel_code string, value_mwh double"), gen)
    fresh = frame([("EIA", at(199), at(199))], "source string, last_fetch_utc timestamp_ntz, last_period_utc timestamp_ntz")
    sla = tables.source_sla(spark)
    demand, generation = spark.read.parquet(path), spark.read.parquet(gen)
    report = quality.validation_report(demand, generation, fresh, sla, at(199))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("series#") and plan.count(f"{path}]") == 1 and plan.count(f"{gen}]") == 1
    got = {r["name"]: r for r in report.collect()}
    own = demand.where("series = 'D'")
    parts = [quality.check_freshness(fresh, sla), quality.check_plausibility(own, at(199)), quality.check_energy_balance(demand, at(199)), quality.check_fuel_shares(demand, generation, at(199))]
    for part in parts:
        want = part.first()
        assert all(got[want["name"]][c] == want[c] for c in part.columns), want["name"]
    assert {r["as_of_utc"] for r in got.values()} == {at(199)}
    plain = {tuple(r) for r in quality.validation_report(demand, generation, fresh, sla).collect()}
    assert plain == {tuple(r) for r in report.collect()}


# --- runs' payloads, compaction ----------------------------------------------------------------


def test_a_run_keeps_its_payload_and_the_log_can_be_compacted(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(3):
        upkeep.record_run(spark, path, f"s{i}", "ok", i, at(i), at(i + 1), payload={"pages": i, "window": {"from": "x"}} if i else None)
    assert len(list(Path(path).rglob("*.parquet"))) == 3
    upkeep.compact(spark, path)
    rows = spark.read.parquet(path)
    pages = {r["source"]: r["n"] for r in rows.select("source", drift.field("pages", "int", "payload").alias("n")).collect()}
    assert pages == {"s0": None, "s1": 1, "s2": 2} and len(list(Path(path).rglob("*.parquet"))) == 1
    assert json.loads(rows.where("source = 's2'").select(F.to_json("payload").alias("j")).first()["j"]) == {"pages": 2, "window": {"from": "x"}}


# --- two-stage regression ----------------------------------------------------------------------


def plain_fit(values):
    y = np.asarray(values) - np.mean(values)
    n, first = len(y), 25
    x = np.array([[y[t - k] for k in range(1, 26)] for t in range(first, n)])
    e = np.zeros(n)
    e[first:] = y[first:] - x @ np.linalg.lstsq(x, y[first:], rcond=None)[0]
    rows = range(first + 25, n)
    both = np.array([[*(y[t - k] for k in (1, 24, 25)), *(e[t - k] for k in (1, 24, 25))] for t in rows])
    return np.linalg.lstsq(both, y[first + 25 :], rcond=None)[0]


def test_coefficients_equal_plain_least_squares_for_all_keys(spark):
    draw, rows = np.random.default_rng(5), []
    series = {}
    for key in ("a", "b", "c"):
        noise, y = draw.normal(0, 1, 340), np.zeros(340)
        for t in range(25, 340):
            y[t] = 0.5 * y[t - 1] + 0.4 * y[t - 24] - 0.2 * y[t - 25] + noise[t] + 0.3 * noise[t - 1]
        series[key] = 100 + y[4:340]
        rows += [(at(h), key, float(v)) for h, v in enumerate(series[key])]
    rows += [(at(h), "flat", 5.0) for h in range(336)] + [(at(h), "short", float(h % 7)) for h in range(250, 336)]
    df = spark.createDataFrame(rows, SCHEMA)
    grid = forecast.regular_grid(forecast.history(df, at(335)))
    found = {r["ba_code"]: r for r in arma.fitted(grid, 24, "ba_code").collect()}
    assert set(found) == {"a", "b", "c"}
    for key in found:
        values = [v for h, k, v in sorted(rows) if k == key and h > at(335) - dt.timedelta(days=14)]
        assert np.allclose(found[key]["coefficients"], plain_fit(values), rtol=1e-3, atol=1e-4)
        assert len(found[key]["yhat"]) == 24 and np.all(np.diff(found[key]["width"]) >= 0)
    every = arma.arma_forecast(df, at(335))
    models = {r["ba_code"]: r["model_name"] for r in every.collect()}
    assert every.count() == 5 * 24 and models["a"] == arma.MODEL and models["flat"] != arma.MODEL and models["short"] != arma.MODEL
    truth = series["a"]
    assert abs(np.mean(found["a"]["yhat"]) - np.mean(truth)) < 6
