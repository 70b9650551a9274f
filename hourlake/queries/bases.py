"""Projections, filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlake.functions.labels import is_high_severity, severity, severity_rank
from hourlake.functions.numbers import pct
from hourlake.operators import filters, joins, ranking, rollups
from hourlake.plans import marts, reports
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import query, rounded

DEMAND_FORECAST_SQL = """SELECT d.period_utc, d.ba_code, round(d.value_mwh, 4) AS demand_mwh, round(f.value_mwh, 4) AS forecast_mwh"""


@query(
    "staged_demand",
    "PRJ1",
    ctes("demand_raw", "SELECT period_utc, ba_code, round(value_mwh, 4) AS demand_mwh, source FROM demand_raw WHERE series = 'D'"),
)
def _(b):
    return rounded(filters.series_rows(b.demand_raw))


@query(
    "staged_renames",
    "PRJ2",
    ctes(
        "day_ahead generation interchange",
        """SELECT 'forecast' AS tbl, count(*) AS n, round(sum(value_mwh), 4) AS total FROM day_ahead
 UNION ALL SELECT 'generation', count(*), round(sum(value_mwh), 4) FROM generation
 UNION ALL SELECT 'interchange', count(*), round(sum(value_mwh), 4) FROM interchange""",
    ),
)
def _(b):
    frames = {
        "forecast": (b.day_ahead, "forecast_mwh"),
        "generation": (b.generation, "generation_mwh"),
        "interchange": (b.interchange, "net_mwh"),
    }
    parts = [
        filters.rename_value(df, "value_mwh", new).agg(F.count(F.lit(1)).alias("n"), F.sum(new).alias("total")).withColumn("tbl", F.lit(name))
        for name, (df, new) in frames.items()
    ]
    return rounded(ranking.union_all(*parts))


@query(
    "trailing_window",
    "PRJ3 SRC13",
    ctes("", "SELECT event_id, ts, value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 48 HOUR"),
)
def _(b):
    return filters.trailing(b.table("events").select("event_id", "ts", "value"), "ts", 48, b.weather_now)


@query(
    "trailing_window_per_key",
    "PRJ4",
    ctes(
        "",
        """SELECT e.event_id, e.event_type, e.ts FROM events e
 JOIN (SELECT event_type, max(ts) AS m FROM events GROUP BY 1) x ON e.event_type = x.event_type
 WHERE e.ts > x.m - INTERVAL 24 HOUR""",
    ),
)
def _(b):
    return filters.trailing_per_key(b.table("events").select("event_id", "event_type", "ts"), "ts", 24, "event_type")


@query(
    "settled_hours",
    "PRJ5",
    ctes(
        "dnow",
        """SELECT period_utc, ba_code, round(value_mwh, 4) AS value_mwh FROM demand, dnow
 WHERE period_utc > now - INTERVAL 72 HOUR AND period_utc <= now - INTERVAL 3 HOUR""",
    ),
)
def _(b):
    return rounded(filters.settled(b.demand, "period_utc", b.demand_now))


@query(
    "one_key",
    "PRJ6",
    ctes("demand", "SELECT period_utc, ba_code, round(value_mwh, 4) AS value_mwh FROM demand WHERE ba_code = 'click'"),
)
def _(b):
    return rounded(filters.only_key(b.demand, "ba_code", "click"))


@query(
    "active_keys",
    "PRJ7",
    ctes("", "SELECT DISTINCT event_type AS ba_code FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 168 HOUR"),
)
def _(b):
    events = b.table("events").select(F.col("event_type").alias("ba_code"), "ts")
    return filters.active_keys(events, "ba_code", "ts", b.weather_now)


@query(
    "demand_latest",
    "PRJ8",
    ctes(
        "dnow",
        "SELECT period_utc, ba_code, round(value_mwh, 4) AS value_mwh FROM demand, dnow WHERE period_utc > now - INTERVAL 24 HOUR",
    ),
)
def _(b):
    return rounded(filters.demand_latest(b.demand, 24, b.demand_now))


@query(
    "percent_rules",
    "PRJ10",
    ctes(
        "",
        """SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN round(o_totalprice / c_acctbal * 100, 4) END AS gt0,
 round(o_totalprice / nullif(c_acctbal, 0) * 100, 4) AS nullif_rule,
 round(abs(o_totalprice) / nullif(abs(c_acctbal), 0) * 100, 4) AS abs_rule
 FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
)
def _(b):
    rows = b.table("orders").join(b.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    num, den = "o_totalprice", "c_acctbal"
    return rounded(
        rows.select(
            "o_orderkey", pct(num, den).alias("gt0"), pct(num, den, "nullif").alias("nullif_rule"), pct(num, den, "abs").alias("abs_rule")
        )
    )


Z_SQL = "SELECT event_id, event_type, (value - 60) / 40 AS z FROM events"


@query(
    "severity_bands",
    "PRJ11 PRJ12",
    ctes(
        "",
        """SELECT severity, CASE severity WHEN 'critical' THEN 3 WHEN 'warn' THEN 2 ELSE 0 END AS rank,
 count(*) AS n, CAST(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS high,
 CAST(sum(CASE WHEN abs(z) >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS flagged
 FROM (SELECT z, CASE WHEN abs(z) >= 3 THEN 'critical' WHEN abs(z) >= 2 THEN 'warn' ELSE 'info' END AS severity FROM scored) s
 GROUP BY 1, 2""",
        scored=Z_SQL,
    ),
)
def _(b):
    z = (F.col("value") - 60) / 40
    scored = b.table("events").select(z.alias("z"), severity(z).alias("severity"))
    return scored.groupBy("severity", severity_rank("severity").alias("rank")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_high_severity("severity")).alias("high"),
        F.count_if(F.abs("z") >= 2).alias("flagged"),
    )


@query(
    "freshness_ages",
    "PRJ13",
    ctes(
        "freshness onow",
        """SELECT source, last_rows, CAST(date_diff('second', last_fetch_utc, now) AS DOUBLE) AS sec_since_fetch,
 CAST(date_diff('second', last_period_utc, now) AS DOUBLE) AS sec_since_period FROM freshness, onow""",
    ),
)
def _(b):
    return filters.with_ages(b.freshness, b.ops_now).select("source", "last_rows", "sec_since_fetch", "sec_since_period")


@query(
    "freshness_ages_minutes",
    "PRJ13",
    ctes(
        "freshness onow",
        """SELECT source, date_diff('second', last_fetch_utc, now) / 60.0 AS minutes_since_fetch,
 date_diff('second', last_period_utc, now) / 60.0 AS minutes_since_period FROM freshness, onow""",
    ),
)
def _(b):
    return filters.with_ages(b.freshness, b.ops_now, "minutes").select("source", "minutes_since_fetch", "minutes_since_period")


# --- joins ------------------------------------------------------------------------------------


@query(
    "demand_with_forecast",
    "JON1 PRJ2",
    ctes(
        "demand day_ahead",
        DEMAND_FORECAST_SQL
        + """, round(d.value_mwh - coalesce(f.value_mwh, d.value_mwh), 4) AS forecast_error_mwh
 FROM demand d LEFT JOIN day_ahead f USING (period_utc, ba_code)""",
    ),
)
def _(b):
    demand = filters.rename_value(b.demand, "value_mwh", "demand_mwh")
    forecast = filters.rename_value(b.day_ahead, "value_mwh", "forecast_mwh")
    return rounded(joins.demand_with_forecast(demand, forecast))


FCT_DEMAND = """SELECT d.period_utc, d.ba_code, d.value_mwh AS demand_mwh, f.value_mwh AS forecast_mwh,
 d.value_mwh - coalesce(f.value_mwh, d.value_mwh) AS forecast_error_mwh,
 CASE WHEN f.value_mwh IS NULL OR f.value_mwh = 0 THEN NULL
 ELSE abs(d.value_mwh - f.value_mwh) / abs(f.value_mwh) * 100 END AS abs_forecast_error_pct
 FROM demand d LEFT JOIN day_ahead f USING (period_utc, ba_code)"""


def fct_demand(b):
    raw = b.demand.withColumns({"series": F.lit("D"), "source": F.lit("EIA")})
    return marts.fct_demand(raw, b.day_ahead)


@query(
    "fact_demand_hourly",
    "JON1 PRJ1 PRJ10",
    ctes(
        "demand day_ahead",
        """SELECT period_utc, ba_code, round(demand_mwh, 4) AS demand_mwh, round(forecast_mwh, 4) AS forecast_mwh,
 round(forecast_error_mwh, 4) AS forecast_error_mwh, round(abs_forecast_error_pct, 4) AS abs_forecast_error_pct FROM fct""",
        fct=FCT_DEMAND,
    ),
)
def _(b):
    return rounded(fct_demand(b))


@query(
    "export_demand_hourly",
    "JON2",
    ctes(
        "demand day_ahead dnow",
        DEMAND_FORECAST_SQL
        + """, round(d.value_mwh - f.value_mwh, 4) AS forecast_error_mwh,
 CASE WHEN f.value_mwh > 0 THEN round(abs(d.value_mwh - f.value_mwh) / f.value_mwh * 100, 4) END AS abs_forecast_error_pct
 FROM demand d LEFT JOIN day_ahead f USING (period_utc, ba_code), dnow WHERE d.period_utc > now - INTERVAL 14 DAY""",
    ),
)
def _(b):
    return rounded(joins.demand_vs_forecast_export(b.demand, b.day_ahead, b.demand_now))


GENERATION_META = """SELECT g.period_utc, g.ba_code, g.fuel_code, coalesce(f.fuel_name, g.fuel_code) AS fuel_name,
 coalesce(f.category, 'Other') AS fuel_category, coalesce(f.is_renewable, false) AS is_renewable,
 coalesce(f.is_carbon_free, false) AS is_carbon_free, g.value_mwh AS generation_mwh
 FROM generation g LEFT JOIN fuels f ON g.fuel_code = f.fuel_code"""


@query("generation_with_meta", "JON3 SRC10", ctes("generation fuels", GENERATION_META))
def _(b):
    return marts.fct_generation(b.generation, b.fuels)


@query(
    "key_dimension",
    "JON4",
    ctes(
        "generation nations snow",
        """SELECT s.ba_code, coalesce(n.ba_name, s.ba_code) AS ba_name, coalesce(n.region, 'Unknown') AS region,
 coalesce(n.country, 'US') AS country, coalesce(n.timezone, 'UTC') AS timezone, md5(s.ba_code) AS ba_sk
 FROM (SELECT DISTINCT ba_code FROM generation, snow WHERE period_utc > now - INTERVAL 90 DAY) s
 LEFT JOIN nations n ON s.ba_code = n.ba_code""",
    ),
)
def _(b):
    return joins.dim_keys(b.generation, b.nations, b.shipped_now)


@query(
    "forecast_pairs",
    "JON5",
    ctes(
        "demand day_ahead",
        """SELECT f.ba_code, f.period_utc, round(f.value_mwh, 4) AS yhat, round(d.value_mwh, 4) AS actual
 FROM day_ahead f JOIN demand d USING (ba_code, period_utc)""",
    ),
)
def _(b):
    forecast = filters.rename_value(b.day_ahead, "value_mwh", "yhat")
    return rounded(joins.pair_actuals(forecast, b.demand, ["ba_code", "period_utc"]))


@query(
    "aligned_hours",
    "JON6",
    ctes(
        "demand_long generation_regional",
        """SELECT period_utc, ba_code, round(ng, 4) AS ng, round(fuel, 4) AS fuel
 FROM (SELECT period_utc, ba_code, max(value_mwh) AS ng FROM demand_long WHERE series = 'NG' GROUP BY 1, 2)
 JOIN (SELECT period_utc, ba_code, sum(value_mwh) AS fuel FROM generation_regional GROUP BY 1, 2) USING (period_utc, ba_code)""",
    ),
)
def _(b):
    keys = ["period_utc", "ba_code"]
    ng = b.demand_long.where("series = 'NG'").groupBy(*keys).agg(F.max("value_mwh").alias("ng"))
    fuel = b.generation_regional.groupBy(*keys).agg(F.sum("value_mwh").alias("fuel"))
    return rounded(joins.align_hours(ng, fuel, keys))


@query(
    "share_of_key_total",
    "JON7",
    ctes(
        "generation",
        """SELECT ba_code, fuel_code, round(mwh, 4) AS mwh, round(mwh / t * 100, 4) AS share_pct
 FROM (SELECT ba_code, fuel_code, sum(value_mwh) AS mwh FROM generation GROUP BY 1, 2)
 JOIN (SELECT ba_code, sum(value_mwh) AS t FROM generation GROUP BY 1) USING (ba_code)""",
    ),
)
def _(b):
    sums = b.generation.groupBy("ba_code", "fuel_code").agg(F.sum("value_mwh").alias("mwh"))
    return rounded(joins.share_of_group(sums, ["ba_code"], "mwh"))


@query(
    "readings_with_location",
    "JON8 NRM10",
    ctes(
        "weather stations",
        """SELECT w.period_utc, w.station_id, w.temperature_c, s.ba_code, s.latitude, s.longitude
 FROM (SELECT *, replace(station_id, 'BA:', '') AS code FROM weather) w
 LEFT JOIN stations s ON s.ba_code = w.code""",
    ),
)
def _(b):
    rows = b.weather.select("period_utc", "station_id", "temperature_c")
    return joins.with_location(rows, b.stations, "ba_code", "BA:")


@query(
    "forecast_timeline",
    "JON9",
    ctes(
        "demand day_ahead",
        """SELECT ba_code, period_utc, round(d.value_mwh, 4) AS actual,
 round(CASE WHEN period_utc = last.m THEN coalesce(f.value_mwh, d.value_mwh) ELSE f.value_mwh END, 4) AS yhat,
 round(f.value_mwh * 0.9, 4) AS lower, round(f.value_mwh * 1.1, 4) AS upper
 FROM demand d FULL OUTER JOIN day_ahead f USING (ba_code, period_utc)
 LEFT JOIN (SELECT ba_code, max(period_utc) AS m FROM demand GROUP BY 1) last USING (ba_code)""",
    ),
)
def _(b):
    v = F.col("value_mwh")
    forecast = b.day_ahead.select(
        "ba_code", "period_utc", v.alias("yhat_mwh"), (v * 0.9).alias("yhat_lower"), (v * 1.1).alias("yhat_upper")
    )
    return rounded(joins.forecast_timeline(b.demand, forecast))


@query(
    "share_of_network",
    "JON10",
    ctes(
        "",
        """SELECT event_type, round(sum(value), 4) AS mwh, round(sum(value) / (SELECT sum(value) FROM events) * 100, 4) AS pct
 FROM events GROUP BY 1""",
    ),
)
def _(b):
    events = b.table("events")
    sums = events.groupBy("event_type").agg(F.sum("value").alias("mwh"))
    total = joins.with_scalar(sums, sums.agg(F.sum("mwh")), "total")
    return rounded(total.select("event_type", "mwh", (F.col("mwh") / F.col("total") * 100).alias("pct")))


@query(
    "weather_with_station",
    "WIN4 JON8",
    ctes(
        "weather stations",
        """SELECT w.period_utc, w.station_id, w.temperature_c, w.wind_speed_kph, w.short_forecast, w.code AS ba_code,
 s.latitude, s.longitude FROM (SELECT *, replace(station_id, 'BA:', '') AS code,
 row_number() OVER (PARTITION BY station_id ORDER BY period_utc DESC) AS rn FROM weather
 WHERE period_utc > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR) w
 LEFT JOIN stations s ON s.ba_code = w.code WHERE rn = 1""",
    ),
)
def _(b):
    return reports.weather_latest(b.weather, b.stations, b.weather_now)


@query(
    "export_slices",
    "PRJ14 TOP2",
    ctes(
        "interchange vintages snow dnow fuels runs",
        """SELECT 'forecast' AS name, count(*) AS n FROM vintages, dnow WHERE fit_at_utc > now - INTERVAL 24 HOUR
 UNION ALL SELECT 'interchange', count(*) FROM interchange, snow WHERE period_utc > now - INTERVAL 168 HOUR
 UNION ALL SELECT 'fuel_types', count(*) FROM fuels
 UNION ALL SELECT 'ingest_runs', count(*) FROM (SELECT * FROM runs ORDER BY started_at DESC LIMIT 200)""",
    ),
)
def _(b):
    rows = reports.export_slices(b.vintages, b.vintages, b.interchange, b.runs, b.fuels, b.shipped_now)
    rows["forecast"] = reports.export_slices(b.vintages, b.vintages, b.interchange, b.runs, b.fuels, b.demand_now)["forecast"]
    parts = [
        rows[name][0].agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        for name in ("forecast", "interchange", "fuel_types", "ingest_runs")
    ]
    return ranking.union_all(*parts)


@query(
    "last_runs",
    "TOP2",
    ctes(
        "runs",
        """SELECT run_id, source, started_at, rows_written, status FROM runs ORDER BY started_at DESC, run_id LIMIT 200""",
    ),
)
def _(b):
    return ranking.last_rows(b.runs, "started_at", 200, ["run_id"])


@query(
    "table_census",
    "AGG22 SET1",
    ctes(
        "",
        """SELECT 'events' AS tbl, count(*) AS n_rows, max(ts) AS last_period_utc FROM events
 UNION ALL SELECT 'orders', count(*), max(o_orderdate) FROM orders
 UNION ALL SELECT 'lineitem', count(*), max(l_shipdate) FROM lineitem
 UNION ALL SELECT 'customer', count(*), NULL FROM customer
 UNION ALL SELECT 'supplier', count(*), NULL FROM supplier
 UNION ALL SELECT 'part', count(*), NULL FROM part
 UNION ALL SELECT 'nation', count(*), NULL FROM nation
 UNION ALL SELECT 'region', count(*), NULL FROM region""",
    ),
)
def _(b):
    timed = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    names = ["events", "orders", "lineitem", "customer", "supplier", "part", "nation", "region"]
    return rollups.table_census({n: (b.table(n), timed.get(n)) for n in names})
