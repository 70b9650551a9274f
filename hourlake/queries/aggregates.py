"""Rollups, marts and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlake.operators import filters, joins, ranking, rollups
from hourlake.plans import marts, reports
from hourlake.queries.bases import FCT_DEMAND, GENERATION_META, fct_demand
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import query, rounded


def _rollup_sql(unit: str) -> str:
    return f"""SELECT date_trunc('{unit}', ts) AS bucket_utc, event_type AS ba_code, round(avg(value), 9) AS avg_mwh,
 max(value) AS peak_mwh, min(value) AS trough_mwh, count(*) AS n_obs FROM events GROUP BY 1, 2"""


def _events_as_demand(b):
    return b.table("events").select(F.col("ts").alias("period_utc"), F.col("event_type").alias("ba_code"), F.col("value").alias("value_mwh"))


@query("demand_rollup_hourly", "AGG1", _rollup_sql("hour"))
def _(b):
    return rounded(rollups.rollup(_events_as_demand(b), "1 hour", ["ba_code"]), 9)


@query("demand_rollup_daily", "AGG2", _rollup_sql("day"))
def _(b):
    return rounded(rollups.rollup(_events_as_demand(b), "1 day", ["ba_code"]), 9)


@query(
    "generation_rollup_hourly",
    "AGG3",
    ctes("generation", "SELECT date_trunc('hour', period_utc) AS bucket_utc, ba_code, fuel_code, sum(value_mwh) AS total_mwh FROM generation GROUP BY 1, 2, 3"),
)
def _(b):
    return rollups.rollup_sum(b.generation, "1 hour", ["ba_code", "fuel_code"])


@query(
    "demand_recent",
    "AGG4",
    ctes(
        "demand day_ahead dnow",
        """SELECT ba_code, count(*) AS n_obs, min(period_utc) AS first_period_utc, max(period_utc) AS last_period_utc,
 round(avg(demand_mwh), 4) AS avg_mwh, round(max(demand_mwh), 4) AS peak_mwh, round(min(demand_mwh), 4) AS trough_mwh,
 round(avg(abs_forecast_error_pct), 4) AS avg_abs_error_pct, round(quantile_cont(demand_mwh, 0.95), 4) AS p95_mwh
 FROM fct, dnow WHERE period_utc > now - INTERVAL 72 HOUR GROUP BY 1""",
        fct=FCT_DEMAND,
    ),
)
def _(b):
    return rounded(rollups.agg_demand_recent(fct_demand(b), b.demand_now))


@query(
    "generation_mix_recent",
    "AGG5 JON7",
    ctes(
        "generation fuels snow",
        """SELECT ba_code, fuel_code, fuel_name, fuel_category, is_renewable, is_carbon_free, mwh,
 round(CASE WHEN t > 0 THEN mwh / t * 100 END, 4) AS share_pct FROM by_fuel JOIN (SELECT ba_code, sum(mwh) AS t FROM by_fuel GROUP BY 1) USING (ba_code)""",
        by_fuel="""SELECT ba_code, fuel_code, fuel_name, fuel_category, is_renewable, is_carbon_free, sum(generation_mwh) AS mwh
 FROM (SELECT * FROM meta, snow WHERE period_utc > now - INTERVAL 168 HOUR) GROUP BY ALL""".replace("FROM meta", f"FROM ({GENERATION_META}) meta"),
    ),
)
def _(b):
    fct = marts.fct_generation(b.generation, b.fuels)
    return rounded(rollups.agg_generation_mix_recent(fct, b.shipped_now, 168))


@query(
    "renewable_share",
    "AGG6 JON3",
    ctes(
        "generation fuels snow",
        """SELECT period_utc, r AS renewable_mwh, c AS carbon_free_mwh, t AS total_mwh,
 round(CASE WHEN t > 0 THEN r / t * 100 END, 4) AS renewable_pct, round(CASE WHEN t > 0 THEN c / t * 100 END, 4) AS carbon_free_pct
 FROM (SELECT period_utc, sum(CASE WHEN is_renewable THEN generation_mwh ELSE 0 END) AS r,
 sum(CASE WHEN is_carbon_free THEN generation_mwh ELSE 0 END) AS c, sum(generation_mwh) AS t
 FROM meta, snow WHERE period_utc > now - INTERVAL 72 HOUR GROUP BY 1)""",
        meta=GENERATION_META,
    ),
)
def _(b):
    return rounded(rollups.agg_renewable_share(marts.fct_generation(b.generation, b.fuels), b.shipped_now))


@query(
    "renewable_share_export",
    "AGG7",
    ctes(
        "generation fuels snow",
        """SELECT period_utc, t AS total_mwh, r AS renewable_mwh, c AS carbon_free_mwh,
 round(CASE WHEN t > 0 THEN r / t * 100 END, 4) AS renewable_pct, round(CASE WHEN t > 0 THEN c / t * 100 END, 4) AS carbon_free_pct
 FROM (SELECT period_utc, sum(value_mwh) AS t, sum(value_mwh) FILTER (WHERE is_renewable) AS r,
 sum(value_mwh) FILTER (WHERE is_carbon_free) AS c FROM generation LEFT JOIN fuels USING (fuel_code), snow
 WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1)""",
    ),
)
def _(b):
    return rounded(rollups.renewable_share_export(b.generation, b.fuels, b.shipped_now))


@query(
    "generation_mix",
    "AGG8 PRJ4",
    ctes("generation snow", "SELECT period_utc, fuel_code, sum(value_mwh) AS value_mwh FROM generation, snow WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1, 2"),
)
def _(b):
    return rollups.generation_mix(b.generation, 168)


@query(
    "generation_mix_one_key",
    "AGG8 PRJ4 PRJ6",
    ctes(
        "generation",
        """SELECT period_utc, fuel_code, sum(value_mwh) AS value_mwh FROM generation WHERE ba_code = 'N7'
 AND period_utc > (SELECT max(period_utc) FROM generation WHERE ba_code = 'N7') - INTERVAL 168 HOUR GROUP BY 1, 2""",
    ),
)
def _(b):
    return rollups.generation_mix(b.generation, 168, "N7")


SHARE = """SELECT fuel_code, fuel_name, is_renewable, is_carbon_free, mwh, mwh / nullif(sum(mwh) OVER (), 0) * 100 AS pct
 FROM (SELECT fuel_code, sum(value_mwh) AS mwh FROM generation, snow WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1)
 LEFT JOIN fuels USING (fuel_code)"""


@query(
    "generation_share",
    "AGG9",
    ctes("generation fuels snow", "SELECT * REPLACE (round(pct, 4) AS pct) FROM share", share=SHARE),
)
def _(b):
    return rounded(rollups.generation_share(b.generation, b.fuels, 168))


@query(
    "generation_totals",
    "AGG10",
    ctes(
        "generation fuels snow",
        """SELECT sum(mwh) AS total_mwh, round(sum(CASE WHEN is_carbon_free THEN pct ELSE 0 END), 4) AS carbon_free_pct,
 round(sum(CASE WHEN is_renewable THEN pct ELSE 0 END), 4) AS renewable_pct FROM share""",
        share=SHARE,
    ),
)
def _(b):
    return rounded(rollups.share_totals(rollups.generation_share(b.generation, b.fuels, 168)))


FLOWS = """SELECT from_ba, to_ba, sum(value_mwh) AS net_mwh, count(*) AS n_obs FROM interchange, snow
 WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1, 2"""


@query(
    "interchange_flows",
    "AGG11 TOP1",
    ctes("interchange snow", "SELECT from_ba, to_ba, round(net_mwh, 4) AS net_mwh, n_obs FROM flows", flows=FLOWS),
)
def _(b):
    return rounded(rollups.interchange_flows(b.interchange, 168, b.shipped_now))


@query(
    "zone_load",
    "AGG12",
    ctes("zone_load snow", "SELECT period_utc, bidding_zone, sum(value_mw) AS value_mw FROM zone_load, snow WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1, 2"),
)
def _(b):
    return rollups.zone_load(b.zone_load, 168, b.shipped_now)


@query(
    "demand_network",
    "AGG13",
    ctes(
        "dnow",
        """SELECT period_utc, round(sum(value_mwh), 4) AS mwh, count(*) AS bas FROM demand, dnow
 WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1""",
    ),
)
def _(b):
    return rounded(rollups.demand_network(filters.trailing(b.demand, "period_utc", 168, b.demand_now)))


@query(
    "demand_by_key",
    "AGG13",
    ctes("dnow", "SELECT ba_code, round(avg(value_mwh), 9) AS avg_mw FROM demand, dnow WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1"),
)
def _(b):
    return rounded(rollups.demand_by_key(filters.trailing(b.demand, "period_utc", 168, b.demand_now)), 9)


PAIRS = """SELECT CASE WHEN net >= 0 THEN lo ELSE hi END AS from_ba, CASE WHEN net >= 0 THEN hi ELSE lo END AS to_ba, abs(net) / 1000 AS gw
 FROM (SELECT least(from_ba, to_ba) AS lo, greatest(from_ba, to_ba) AS hi,
 avg(CASE WHEN from_ba <= to_ba THEN net_mwh ELSE -net_mwh END) AS net FROM flows GROUP BY 1, 2)"""
ALL_FLOWS = "SELECT from_ba, to_ba, sum(value_mwh) AS net_mwh, count(*) AS n_obs FROM interchange GROUP BY 1, 2"


def all_flows(b):
    return b.interchange.groupBy("from_ba", "to_ba").agg(F.sum("value_mwh").alias("net_mwh"), F.count(F.lit(1)).alias("n_obs"))


@query(
    "mirror_pairs",
    "AGG14",
    ctes("interchange", f"SELECT from_ba, to_ba, round(gw, 3) AS gw FROM ({PAIRS})", flows=ALL_FLOWS),
)
def _(b):
    return rounded(rollups.mirror_pairs(all_flows(b)), 3)


@query(
    "flow_totals",
    "AGG14 SET3",
    ctes(
        "interchange",
        """SELECT round(sum(abs(net_mwh)) / 1000, 3) AS total_gw,
 (SELECT count(DISTINCT ba) FROM (SELECT from_ba AS ba FROM flows UNION ALL SELECT to_ba FROM flows)) AS distinct_bas FROM flows""",
        flows=ALL_FLOWS,
    ),
)
def _(b):
    return rounded(rollups.flow_totals(all_flows(b)), 3)


@query(
    "zone_summary",
    "AGG15",
    ctes(
        "zone_load",
        """SELECT bidding_zone, round(avg(value_mw), 9) AS avg_mw, round(sum(value_mw), 4) AS total_mw,
 round(sum(value_mw) * 0.25, 4) AS energy_mwh FROM zone_load GROUP BY 1""",
    ),
)
def _(b):
    return rounded(rollups.zone_summary(b.zone_load, 0.25), 9)


@query(
    "zone_totals",
    "AGG15",
    ctes("zone_load", "SELECT max(mw) AS peak_total_mw, sum(mw) AS total_mw FROM (SELECT period_utc, sum(value_mw) AS mw FROM zone_load GROUP BY 1)"),
)
def _(b):
    return rollups.zone_totals(b.zone_load)


SCORES = """SELECT ba_code, grouping(ba_code) = 1 AS is_total, count(*) AS pairs,
 round(avg(abs(actual - yhat) / nullif(actual, 0)) * 100, 4) AS mape_pct, round(sqrt(avg(power(actual - yhat, 2))), 4) AS rmse_mwh
 FROM (SELECT d.ba_code, d.value_mwh AS actual, f.value_mwh AS yhat FROM demand d JOIN day_ahead f USING (ba_code, period_utc))
 GROUP BY GROUPING SETS ((), (ba_code))"""


def _score_pairs(b):
    forecast = filters.rename_value(b.day_ahead, "value_mwh", "yhat")
    return joins.pair_actuals(forecast, b.demand, ["ba_code", "period_utc"])


@query("score_sets", "AGG16 AGG17", ctes("demand day_ahead", SCORES))
def _(b):
    return rounded(rollups.score_sets(_score_pairs(b)))


@query("score_grouping_sets", "AGG16 AGG17", ctes("demand day_ahead", SCORES))
def _(b):
    return rounded(rollups.score_grouping_sets(_score_pairs(b)))


@query(
    "plausibility_counts",
    "AGG18",
    """SELECT count(*) AS observations, count(*) FILTER (WHERE c_acctbal IS NULL) AS nulls,
 count(*) FILTER (WHERE c_acctbal <= 0) AS non_positive, count(DISTINCT o_custkey) AS bas
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 168 HOUR""",
)
def _(b):
    orders = b.table("orders").join(b.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = orders.select(F.col("o_orderdate").alias("period_utc"), F.col("o_custkey").alias("ba_code"), F.col("c_acctbal").alias("value_mwh"))
    return rollups.plausibility_counts(rows, b.table("orders").agg(F.max("o_orderdate")).scalar(), 168)


@query(
    "series_wide",
    "AGG19",
    ctes(
        "demand_long",
        """SELECT period_utc, ba_code, max(value_mwh) FILTER (WHERE series = 'D') AS d,
 max(value_mwh) FILTER (WHERE series = 'NG') AS ng, max(value_mwh) FILTER (WHERE series = 'TI') AS ti FROM demand_long GROUP BY 1, 2""",
    ),
)
def _(b):
    return rollups.series_wide(b.demand_long)


@query("count_by_key", "AGG20", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(b):
    return rollups.count_by(b.table("events"), "event_type")


@query(
    "extreme_rows",
    "AGG21",
    """SELECT * FROM (SELECT 'warmest' AS what, event_id, user_id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'coolest', event_id, user_id, value FROM events ORDER BY value, event_id LIMIT 1)""",
)
def _(b):
    rows = b.table("events").select("event_id", "user_id", "value")
    warm = rollups.arg_extreme(rows, "value", "max").withColumn("what", F.lit("warmest"))
    cool = rollups.arg_extreme(rows, "value", "min").withColumn("what", F.lit("coolest"))
    return ranking.union_all(warm, cool)


@query(
    "extreme_row_per_key",
    "AGG21",
    """SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id DESC) AS rn
 FROM events) WHERE rn = 1""",
)
def _(b):
    return rollups.arg_extreme(b.table("events"), "value", "max", ["event_type"], ["event_id", "value"])


@query(
    "forecast_scorecard",
    "AGG23",
    ctes(
        "demand day_ahead dnow",
        """SELECT round(avg(CASE WHEN f.value_mwh > 0 THEN abs(d.value_mwh - f.value_mwh) / f.value_mwh * 100 END), 4) AS mape_pct,
 round(avg(d.value_mwh - f.value_mwh), 4) AS bias_mwh,
 round(100 - avg(CASE WHEN f.value_mwh > 0 THEN abs(d.value_mwh - f.value_mwh) / f.value_mwh * 100 END), 4) AS accuracy_pct
 FROM demand d LEFT JOIN day_ahead f USING (period_utc, ba_code), dnow WHERE d.period_utc > now - INTERVAL 14 DAY""",
    ),
)
def _(b):
    return rounded(rollups.forecast_scorecard(joins.demand_vs_forecast_export(b.demand, b.day_ahead, b.demand_now)))


@query(
    "demand_change",
    "AGG24",
    ctes(
        "dnow",
        """SELECT round(n, 4) AS mwh_now, round(p, 4) AS mwh_24h_ago, round((n - p) / nullif(p, 0) * 100, 4) AS delta_pct
 FROM (SELECT sum(value_mwh) FILTER (WHERE period_utc = now) AS n,
 sum(value_mwh) FILTER (WHERE period_utc = now - INTERVAL 24 HOUR) AS p FROM demand, dnow)""",
    ),
)
def _(b):
    return rounded(rollups.demand_change(b.demand, b.demand_now))


@query(
    "run_measures",
    "AGG26",
    ctes(
        "runs",
        """SELECT count(*) FILTER (WHERE status = 'ok') AS ok_runs, count(*) FILTER (WHERE status = 'error') AS error_runs
 FROM runs WHERE started_at >= (SELECT max(started_at) FROM runs) - INTERVAL 24 HOUR""",
    ),
)
def _(b):
    return rollups.run_measures(b.runs, b.table("orders").agg(F.max("o_orderdate")).scalar())


@query(
    "freshness_measures",
    "AGG26",
    ctes(
        "freshness onow",
        """SELECT max(date_diff('second', last_fetch_utc, now) / 60.0) AS max_lag_min,
 arg_max(source, date_diff('second', last_fetch_utc, now)) AS worst_source FROM freshness, onow""",
    ),
)
def _(b):
    return rollups.freshness_measures(filters.with_ages(b.freshness, b.ops_now, "minutes"))


@query(
    "top_fuel",
    "AGG27",
    ctes(
        "generation fuels",
        """SELECT coalesce(fuel_name, fuel_code) AS fuel_name, sum(value_mwh) AS mwh FROM generation LEFT JOIN fuels USING (fuel_code)
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    ),
)
def _(b):
    return rollups.top_group(marts.fct_generation(b.generation, b.fuels), "fuel_name", "generation_mwh")


@query(
    "highest_demand_key",
    "AGG27",
    ctes(
        "dnow",
        """SELECT ba_code, round(sum(value_mwh), 4) AS mwh FROM demand, dnow WHERE period_utc > now - INTERVAL 24 HOUR
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    ),
)
def _(b):
    return rounded(rollups.top_group(filters.trailing(b.demand, "period_utc", 24, b.demand_now), "ba_code", "value_mwh"))


@query(
    "energy_by_key",
    "AGG27",
    ctes("demand", "SELECT ba_code, round(sum(value_mwh), 4) AS mwh, round(sum(value_mwh) / 1000, 4) AS gwh FROM demand GROUP BY 1"),
)
def _(b):
    return rounded(rollups.energy_measures(b.demand, "ba_code", "value_mwh"))




@query(
    "demand_bundle_series",
    "AGG13 DQ10",
    ctes(
        "dnow",
        """SELECT period_utc, ba_code, round(value_mwh, 4) AS value_mwh FROM demand, dnow
 WHERE period_utc > now - INTERVAL 168 HOUR AND period_utc NOT IN (SELECT period_utc FROM run WHERE bad = 1 AND rn <= least(3, n - 2))""",
        buckets="""SELECT period_utc, sum(value_mwh) AS mwh, count(*) AS bas FROM demand, dnow
 WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1""",
        ranked="""SELECT *, row_number() OVER (ORDER BY period_utc DESC) AS rn, count(*) OVER () AS n,
 CASE WHEN bas < 0.9 * (SELECT median(bas) FROM buckets) OR mwh < 0.6 * (SELECT median(mwh) FROM buckets) THEN 1 ELSE 0 END AS inc FROM buckets""",
        run="SELECT *, min(inc) OVER (ORDER BY rn) AS bad FROM ranked",
    ),
)
def _(b):
    return rounded(reports.demand_bundle(b.demand, 168, b.demand_now)["key_series"])
