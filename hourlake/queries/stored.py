"""Stored tables: every query writes to a fresh shared folder and returns what is read back."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hourlake.operators import filters, joins, upkeep
from hourlake.plans import marts
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import plain_time, query, rounded
from hourlake.session import shared_dir
from hourlake.sources import normalize
from hourlake.sources.tables import read_facts

KEYS = ["period_utc", "ba_code"]


def _back(b, path: str) -> DataFrame:
    return b.spark.read.parquet(path).drop(upkeep.DATE_COL)


def _hours(n: int):
    return F.expr(f"INTERVAL '{n}' HOUR")


@query(
    "upsert_overlapping_batches",
    "SNK1 SNK12",
    ctes(
        "dnow",
        """SELECT period_utc, ba_code, round(CASE WHEN period_utc > now - INTERVAL 72 HOUR THEN value_mwh * 2 ELSE value_mwh END, 4) AS value_mwh FROM demand, dnow""",
    ),
)
def _(b):
    path = shared_dir(b.spark, "demand")
    t = F.col("period_utc")
    now = b.demand_now
    upkeep.upsert(b.demand.where(t <= now - _hours(48)), path, KEYS)
    revised = b.demand.where(t > now - _hours(72)).withColumn("value_mwh", F.col("value_mwh") * 2)
    upkeep.upsert(revised, path, KEYS)
    upkeep.upsert(revised, path, KEYS)
    return rounded(_back(b, path))


@query(
    "upsert_last_row_wins",
    "SNK1",
    """SELECT date_trunc('hour', ts) AS period_utc, event_type AS ba_code, arg_max(value, ts) AS value_mwh FROM events GROUP BY 1, 2""",
)
def _(b):
    path = shared_dir(b.spark, "readings")
    hour = F.window("ts", "1 hour")["start"]
    rows = b.table("events").select(hour.alias("period_utc"), F.col("event_type").alias("ba_code"), F.col("value").alias("value_mwh"), "ts")
    upkeep.upsert(rows, path, KEYS, order_col="ts")
    return _back(b, path).drop("ts")


@query(
    "upsert_some_columns",
    "SNK1 SNK10",
    "SELECT event_id AS id, ts AS period_utc, value, CASE WHEN event_type = 'error' THEN 'late' END AS note FROM events",
)
def _(b):
    path = shared_dir(b.spark, "noted")
    rows = b.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("period_utc"), "value", "event_type")
    upkeep.upsert(rows.select("id", "period_utc", "value", F.lit(None).cast("string").alias("note")), path, ["id", "period_utc"])
    noted = rows.where("event_type = 'error'").select("id", "period_utc", F.lit(0.0).alias("value"), F.lit("late").alias("note"))
    upkeep.upsert(noted, path, ["id", "period_utc"], update_cols=["note"])
    return _back(b, path)


@query(
    "copartitioned_pairs",
    "JON1 JON5 SNK1",
    ctes(
        "demand day_ahead dnow",
        """SELECT period_utc, ba_code, round(d.v, 4) AS demand_mwh, round(f.value_mwh, 4) AS forecast_mwh, round(d.v - coalesce(f.value_mwh, d.v), 4) AS forecast_error_mwh
 FROM (SELECT period_utc, ba_code, CASE WHEN period_utc > now - INTERVAL 30 HOUR THEN value_mwh * 2 ELSE value_mwh END AS v FROM demand, dnow) d
 LEFT JOIN day_ahead f USING (period_utc, ba_code)""",
    ),
)
def _(b):
    """Facts and forecasts in equal buckets, kept by upserts: their join shuffles neither side."""
    base = shared_dir(b.spark, "pairs")
    buckets = upkeep.Buckets(8, tuple(KEYS))
    revised = b.demand.where(F.col("period_utc") > b.demand_now - _hours(30)).withColumn("value_mwh", F.col("value_mwh") * 2)
    for name, batch in (("demand", b.demand), ("forecast", b.day_ahead), ("demand", revised)):
        upkeep.upsert(batch, f"{base}/{name}", KEYS, grain="month", buckets=buckets)
    demand, forecast = (upkeep.read_buckets(b.spark, f"{base}/{name}", buckets, "m") for name in ("demand", "forecast"))
    named = filters.rename_value(forecast, "value_mwh", "forecast_mwh")
    return rounded(joins.demand_with_forecast(filters.rename_value(demand, "value_mwh", "demand_mwh"), named))


@query("append_twice", "SNK2", "SELECT event_type, CAST(count(*) * 2 AS BIGINT) AS n FROM events GROUP BY 1")
def _(b):
    path = shared_dir(b.spark, "log")
    rows = b.table("events").select("event_id", "event_type", "ts")
    upkeep.append_rows(rows, path, "ts")
    upkeep.append_rows(rows, path, "ts")
    return _back(b, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "incremental_mart",
    "SNK3",
    ctes(
        "dnow",
        """SELECT period_utc, ba_code, round(CASE WHEN period_utc > now - INTERVAL 84 HOUR THEN value_mwh + 1000 ELSE value_mwh END, 4) AS value_mwh FROM demand, dnow""",
    ),
)
def _(b):
    """A second run after every hour was revised: only the last 36 stored hours and later ones change."""
    path = shared_dir(b.spark, "mart")
    upkeep.refresh_mart(b.demand.where(F.col("period_utc") <= b.demand_now - _hours(48)), path, KEYS)
    upkeep.refresh_mart(b.demand.withColumn("value_mwh", F.col("value_mwh") + 1000), path, KEYS)
    return rounded(_back(b, path))


@query("full_refresh", "SNK4", ctes("demand", "SELECT ba_code, round(sum(value_mwh), 4) AS mwh FROM demand GROUP BY 1"))
def _(b):
    path = shared_dir(b.spark, "totals")
    upkeep.overwrite_table(b.demand, path, "period_utc")
    sums = b.demand.groupBy("ba_code").agg(F.sum("value_mwh").alias("mwh"))
    upkeep.overwrite_table(sums, path)
    return rounded(b.spark.read.parquet(path))


@query(
    "csv_export",
    "SNK5",
    ctes("demand", "SELECT period_utc, ba_code, round(value_mwh, 4) AS value_mwh FROM demand"),
)
def _(b):
    out = shared_dir(b.spark, "export")
    upkeep.export_csv({"demand": (rounded(b.demand), KEYS)}, out)
    return b.spark.read.option("header", "true").schema(b.demand.select("period_utc", "ba_code", "value_mwh").schema).csv(f"{out}/demand")


@query(
    "retention",
    "SNK6",
    ctes(
        "dnow",
        """SELECT period_utc, ba_code, round(value_mwh, 4) AS value_mwh FROM demand, dnow
 WHERE CAST(period_utc AS DATE) >= CAST(now AS DATE) - INTERVAL 10 DAY""",
    ),
)
def _(b):
    path = shared_dir(b.spark, "demand")
    upkeep.append_rows(b.demand, path)
    newest = max(upkeep.stored_dates(b.spark, path))
    upkeep.retain(b.spark, path, newest, days=10)
    return rounded(_back(b, path))


@query(
    "purge_source",
    "SNK7",
    ctes("demand_raw", "SELECT period_utc, ba_code, series, source, round(value_mwh, 4) AS value_mwh FROM demand_raw WHERE source <> 'DEMO'"),
)
def _(b):
    path = shared_dir(b.spark, "demand")
    upkeep.append_rows(b.demand_raw, path)
    upkeep.purge(b.spark, path, F.col("source") == "DEMO")
    return rounded(_back(b, path))


@query(
    "audited_loads",
    "SNK8 SNK9 SNK10 SNK11",
    ctes(
        "demand",
        """SELECT 'good' AS source, count(*) AS last_rows, max(period_utc) AS last_period_utc, CAST(NULL AS VARCHAR) AS last_error, 'ok' AS run_status, count(*) AS run_rows FROM demand
 UNION ALL SELECT 'bad', NULL, NULL, 'ValueError: feed down', 'error', 0""",
    ),
)
def _(b):
    """Two sources, one of which fails: the other is loaded, both are booked."""
    ops, path = shared_dir(b.spark, "ops"), shared_dir(b.spark, "demand")

    def good():
        return upkeep.upsert(b.demand, path, KEYS), b.spark.read.parquet(path)

    def bad():
        raise ValueError("feed down")

    def now():
        return dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)

    for source, load in (("good", good), ("bad", bad)):
        upkeep.run_source(b.spark, ops, source, load, now)
    runs = b.spark.read.parquet(f"{ops}/ingest_run").select("source", F.col("status").alias("run_status"), F.col("rows_written").alias("run_rows"))
    fresh = upkeep.read_freshness(b.spark, f"{ops}/source_freshness").select("source", "last_rows", "last_period_utc", "last_error")
    return plain_time(fresh.join(runs, "source"))


@query(
    "stored_range_scan",
    "SRC13 SNK12",
    ctes(
        "demand",
        """SELECT period_utc, ba_code, round(value_mwh, 4) AS value_mwh FROM demand WHERE period_utc > TIMESTAMP '2024-01-10 06:00:00'
 AND period_utc <= TIMESTAMP '2024-01-20 18:00:00' AND ba_code IN ('view', 'click')""",
    ),
)
def _(b):
    path = shared_dir(b.spark, "demand")
    upkeep.append_rows(b.demand, path)
    rows = read_facts(b.spark, path, dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 20, 18), ba_code=["view", "click"])
    return rounded(rows.drop(upkeep.DATE_COL))


@query(
    "mart_build",
    "SNK3 SNK4 AGG4 AGG5 AGG6 JON4 DQ7",
    ctes(
        "demand day_ahead generation interchange dnow snow",
        """SELECT 'fct_demand_hourly' AS mart, count(*) AS n FROM demand
 UNION ALL SELECT 'fct_generation_hourly', count(*) FROM generation
 UNION ALL SELECT 'fct_interchange_hourly', count(*) FROM interchange
 UNION ALL SELECT 'agg_demand_recent', count(DISTINCT ba_code) FROM demand, dnow WHERE period_utc > now - INTERVAL 72 HOUR
 UNION ALL SELECT 'agg_generation_mix_recent', count(DISTINCT ba_code || fuel_code) FROM generation, snow WHERE period_utc > now - INTERVAL 72 HOUR
 UNION ALL SELECT 'agg_renewable_share_network', count(DISTINCT period_utc) FROM generation, snow WHERE period_utc > now - INTERVAL 72 HOUR
 UNION ALL SELECT 'dim_balancing_authority', count(DISTINCT ba_code) FROM demand, dnow WHERE period_utc > now - INTERVAL 90 DAY""",
    ),
)
def _(b):
    out = shared_dir(b.spark, "marts")
    demand = b.demand.withColumns({"series": F.lit("D"), "source": F.lit("EIA")})
    marts.build_marts(marts.RawTables(demand, b.day_ahead, b.generation, b.interchange, b.fuels, b.nations), out, grain="month")
    names = [*marts.FACT_KEYS, "agg_demand_recent", "agg_generation_mix_recent", "agg_renewable_share_network", "dim_balancing_authority"]
    counts = [b.spark.read.parquet(f"{out}/{n}").agg(F.count(F.lit(1)).alias("n")).withColumn("mart", F.lit(n)) for n in names]
    first, *rest = counts
    for df in rest:
        first = first.unionByName(df)
    return first


MART_VALUES = {
    "fct_demand_hourly": "period_utc AS period, ba_code AS key, CAST(NULL AS STRING) AS other, demand_mwh AS a, forecast_mwh AS b",
    "fct_generation_hourly": "period_utc AS period, ba_code AS key, fuel_code AS other, generation_mwh AS a, CAST(NULL AS DOUBLE) AS b",
    "fct_interchange_hourly": "period_utc AS period, from_ba AS key, to_ba AS other, net_mwh AS a, CAST(NULL AS DOUBLE) AS b",
    "agg_demand_recent": "last_period_utc AS period, ba_code AS key, CAST(NULL AS STRING) AS other, avg_mwh AS a, p95_mwh AS b",
    "agg_generation_mix_recent": "CAST(NULL AS TIMESTAMP_NTZ) AS period, ba_code AS key, fuel_code AS other, mwh AS a, share_pct AS b",
    "agg_renewable_share_network": "period_utc AS period, CAST(NULL AS STRING) AS key, CAST(NULL AS STRING) AS other, total_mwh AS a, renewable_pct AS b",
    "dim_balancing_authority": "CAST(NULL AS TIMESTAMP_NTZ) AS period, ba_code AS key, ba_sk AS other, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b",
}


def _two_sources(df: DataFrame) -> DataFrame:
    """Each row under two sources, the less trusted one with three times the value."""
    kinds = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(f).alias("f")) for s, f in (("EIA", 1.0), ("DEMO", 3.0))])
    return df.withColumn("k", F.explode(kinds)).withColumns({"value_mwh": F.col("value_mwh") * F.col("k.f"), "source": F.col("k.source")}).drop("k")


def _marts(b, out: str, grain: str = "month", until: int | None = None) -> DataFrame:
    demand = b.demand.withColumn("series", F.lit("D"))
    if until is not None:
        demand = demand.where(F.col("period_utc") <= b.demand_now - _hours(until))
    tables = [_two_sources(t) for t in (demand, b.day_ahead, b.generation, b.interchange)]
    return marts.build_marts(marts.RawTables(*tables, b.fuels, b.nations), out, grain=grain)


@query(
    "mart_values",
    "SNK3 SNK4 AGG4 AGG5 AGG6 JON4 DQ6 DQ7",
    ctes(
        "demand day_ahead generation fuels interchange dnow snow",
        """SELECT 'fct_demand_hourly' AS mart, d.period_utc AS period, d.ba_code AS key, NULL AS other, round(d.value_mwh, 4) AS a, round(f.value_mwh, 4) AS b
 FROM demand d LEFT JOIN day_ahead f USING (period_utc, ba_code)
 UNION ALL SELECT 'fct_generation_hourly', period_utc, ba_code, fuel_code, round(value_mwh, 4), NULL FROM generation
 UNION ALL SELECT 'fct_interchange_hourly', period_utc, from_ba, to_ba, round(value_mwh, 4), NULL FROM interchange
 UNION ALL SELECT 'agg_demand_recent', max(period_utc), ba_code, NULL, round(avg(value_mwh), 4), round(quantile_cont(value_mwh, 0.95), 4)
 FROM demand, dnow WHERE period_utc > now - INTERVAL 72 HOUR GROUP BY ba_code
 UNION ALL SELECT 'agg_generation_mix_recent', NULL, ba_code, fuel_code, round(mwh, 4), round(mwh / sum(mwh) OVER (PARTITION BY ba_code) * 100, 4) FROM mix
 UNION ALL SELECT 'agg_renewable_share_network', period_utc, NULL, NULL, round(sum(value_mwh), 4),
 round(sum(CASE WHEN coalesce(is_renewable, false) THEN value_mwh ELSE 0 END) / sum(value_mwh) * 100, 4) FROM recent LEFT JOIN fuels USING (fuel_code) GROUP BY period_utc
 UNION ALL SELECT DISTINCT 'dim_balancing_authority', CAST(NULL AS TIMESTAMP), ba_code, md5(ba_code), NULL, NULL FROM demand, dnow WHERE period_utc > now - INTERVAL 90 DAY""",
        recent="SELECT * FROM generation, snow WHERE period_utc > now - INTERVAL 72 HOUR",
        mix="SELECT ba_code, fuel_code, sum(value_mwh) AS mwh FROM recent GROUP BY 1, 2",
    ),
)
def _(b):
    """All marts, built in two runs from tables with two sources of every hour."""
    out = shared_dir(b.spark, "marts")
    _marts(b, out, until=48)
    _marts(b, out)
    parts = [b.spark.read.parquet(f"{out}/{n}").selectExpr(f"'{n}' AS mart", *columns.split(", ")) for n, columns in MART_VALUES.items()]
    return rounded(reduce(DataFrame.unionByName, parts))


@query(
    "mart_test_rows",
    "DQ7",
    "SELECT mart, test, CAST(0 AS BIGINT) AS failures, 'pass' AS status FROM (VALUES "
    + ", ".join(
        f"('{m}', '{t}')"
        for m, tests in marts.MART_TESTS.items()
        for t in [*(f"not_null_{c}" for c in tests.get("not_null", [])), *tests.get("exprs", {}), *(f"unique_{c}" for c in tests.get("unique", []))]
    )
    + ") AS v(mart, test)",
)
def _(b):
    return _marts(b, shared_dir(b.spark, "marts"))


@query(
    "untested_marts_stay_out",
    "DQ7 SNK4 SNK3",
    ctes(
        "demand dnow",
        """SELECT 'published' AS kind, period_utc AS period, ba_code AS key, round(value_mwh, 4) AS a, CAST(NULL AS VARCHAR) AS status
 FROM demand, dnow WHERE period_utc <= now - INTERVAL 48 HOUR
 UNION ALL SELECT 'test demand_not_negative', NULL, NULL, CAST(count(*) AS DOUBLE), 'fail' FROM demand, dnow
 WHERE period_utc > now - INTERVAL 84 HOUR AND value_mwh > 0
 UNION ALL SELECT 'newest', max(period_utc), NULL, CAST(count(*) AS DOUBLE), NULL FROM demand, dnow
 WHERE period_utc <= now - INTERVAL 48 HOUR AND period_utc > now - INTERVAL 120 HOUR""",
    ),
)
def _(b):
    """A second build brings negative demand: its test fails, and no mart shows any of that build."""
    out = shared_dir(b.spark, "marts")
    _marts(b, out, until=48)
    demand = b.demand.select("period_utc", "ba_code", (-F.col("value_mwh")).alias("value_mwh"), F.lit("D").alias("series"), F.lit("EIA").alias("source"))
    tests = marts.build_marts(marts.RawTables(demand, b.day_ahead, b.generation, b.interchange, b.fuels, b.nations), out, grain="month")
    now = marts.published(b.spark, out)
    stored = now["fct_demand_hourly"].select(F.lit("published").alias("kind"), F.col("period_utc").alias("period"), F.col("ba_code").alias("key"), F.col("demand_mwh").alias("a"))
    failed = tests.where("status = 'fail'").select(F.concat(F.lit("test "), "test").alias("kind"), F.col("failures").cast("double").alias("a"), "status")
    recent = now["agg_demand_recent"].agg(F.max("last_period_utc").alias("period"), F.sum("n_obs").cast("double").alias("a"))
    parts = [stored, failed, recent.withColumn("kind", F.lit("newest"))]
    return rounded(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts))


@query(
    "rejected_periods",
    "NRM1 NRM3 NRM12 SNK1",
    """SELECT 'stored' AS kind, date_trunc('hour', ts) AS period_utc, CAST(user_id AS VARCHAR) AS ba_code, max(value) AS value_mwh, CAST(count(*) AS BIGINT) AS n
 FROM events WHERE event_type <> 'error' AND user_id % 7 <> 0 GROUP BY 2, 3
 UNION ALL SELECT CASE WHEN event_type = 'error' THEN 'period' ELSE 'respondent' END, NULL, NULL, NULL, count(*)
 FROM events WHERE event_type = 'error' OR user_id % 7 = 0 GROUP BY 1""",
)
def _(b):
    """Records with unreadable periods and malformed keys are set aside; the others, with several values
    of an hour, are stored twice with the same result."""
    period = F.when(F.col("event_type") == "error", F.concat(F.lit("on "), F.col("ts").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:00'Z'"))
    key = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("no. "), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string"))
    records = b.table("events").select(period.alias("period"), key.alias("respondent"), F.lit("D").alias("type"), F.col("value").cast("string").alias("value"))
    good, bad = normalize.store_split(records, shared_dir(b.spark, "split"), ["respondent"], strict=True)
    demand, _ = normalize.route_region(good)
    hours = demand.groupBy("period_utc", "ba_code").agg(F.count(F.lit(1)).alias("n"))
    path = shared_dir(b.spark, "demand")
    for _ in range(2):
        upkeep.upsert(demand, path, KEYS)
    stored = b.spark.read.parquet(path).join(hours, KEYS).select(F.lit("stored").alias("kind"), *KEYS, "value_mwh", "n")
    counts = bad.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return plain_time(stored.unionByName(counts, allowMissingColumns=True))
