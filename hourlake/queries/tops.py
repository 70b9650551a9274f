"""Ordering, top-k with a rest, trailing trim, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlake.operators import ranking, rollups
from hourlake.plans import reports
from hourlake.queries.aggregates import ALL_FLOWS, PAIRS, SHARE, SCORES, _score_pairs, all_flows
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import query, rounded


@query(
    "top_zones_and_other",
    "TOP3",
    ctes(
        "zone_load",
        """SELECT period_utc, CASE WHEN rn <= 6 THEN bidding_zone ELSE 'Other' END AS band, sum(value_mw) AS value_mw
 FROM zone_load JOIN (SELECT bidding_zone, row_number() OVER (ORDER BY avg(value_mw) DESC, bidding_zone) AS rn FROM zone_load GROUP BY 1) r
 USING (bidding_zone) GROUP BY 1, 2""",
    ),
)
def _(b):
    return ranking.top_n_other(b.zone_load, "bidding_zone", "value_mw")


BANDS = """SELECT fuel_code, CASE WHEN fuel_code IN (SELECT fuel_code FROM chosen) THEN label ELSE 'Other' END AS band, mwh, pct FROM flagged"""
FLAGGED = """SELECT fuel_code, mwh, pct, CASE fuel_code WHEN 'BAT' THEN 'Battery' WHEN 'PS' THEN 'Pumped Storage'
 ELSE coalesce(fuel_name, fuel_code) END AS label, fuel_code IN ('NG', 'NUC', 'COL', 'WAT', 'WND', 'SUN') AS prim,
 fuel_code <> 'OTH' AND lower(trim(coalesce(fuel_name, fuel_code))) <> 'other' AND (fuel_code IN ('NG', 'NUC', 'COL', 'WAT', 'WND', 'SUN')
 OR ((fuel_code IN ('BAT', 'PS') OR coalesce(fuel_name, fuel_code) <> fuel_code) AND coalesce(pct, 0) >= 1.5)) AS eligible FROM share"""
CHOSEN = "SELECT fuel_code FROM flagged WHERE eligible ORDER BY prim DESC, mwh DESC, fuel_code LIMIT 8"
BAND_CTES = {"share": SHARE, "flagged": FLAGGED, "chosen": CHOSEN, "bands": BANDS}


def _share(b):
    return rollups.generation_share(b.generation, b.fuels, 168)


@query(
    "fuel_bands",
    "TOP4",
    ctes("generation fuels snow", "SELECT fuel_code, band, mwh, round(pct, 4) AS pct FROM bands", **BAND_CTES),
)
def _(b):
    return rounded(ranking.fuel_bands(_share(b)))


@query(
    "fuel_band_series",
    "TOP4",
    ctes(
        "generation fuels snow",
        """SELECT period_utc, band, sum(value_mwh) AS value_mwh FROM generation JOIN bands USING (fuel_code), snow
 WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1, 2""",
        **BAND_CTES,
    ),
)
def _(b):
    return ranking.band_series(rollups.generation_mix(b.generation, 168), ranking.fuel_bands(_share(b)))


@query(
    "fuel_band_shares",
    "TOP5",
    ctes("generation fuels snow", "SELECT band, round(sum(pct), 4) AS pct FROM bands GROUP BY 1", **BAND_CTES),
)
def _(b):
    return rounded(ranking.band_shares(ranking.fuel_bands(_share(b))))


@query(
    "compare_top_keys",
    "TOP6",
    ctes(
        "demand",
        """SELECT period_utc, max(CASE WHEN rn = 1 THEN ba_code END) AS key_1, round(sum(CASE WHEN rn = 1 THEN value_mwh END), 4) AS value_1,
 max(CASE WHEN rn = 2 THEN ba_code END) AS key_2, round(sum(CASE WHEN rn = 2 THEN value_mwh END), 4) AS value_2,
 max(CASE WHEN rn = 3 THEN ba_code END) AS key_3, round(sum(CASE WHEN rn = 3 THEN value_mwh END), 4) AS value_3
 FROM demand JOIN (SELECT ba_code, row_number() OVER (ORDER BY avg(value_mwh) DESC, ba_code) AS rn FROM demand GROUP BY 1) r USING (ba_code)
 WHERE rn <= 3 GROUP BY 1""",
    ),
)
def _(b):
    return rounded(ranking.compare_wide(b.demand, "ba_code", "value_mwh"))


@query(
    "top_pairs",
    "TOP7 AGG14",
    ctes("interchange", f"SELECT from_ba, to_ba, round(gw, 3) AS gw FROM ({PAIRS}) ORDER BY gw DESC LIMIT 10", flows=ALL_FLOWS),
)
def _(b):
    return rounded(ranking.top_k(rollups.mirror_pairs(all_flows(b)), "gw", 10, ["from_ba", "to_ba"]), 3)


@query("scores_by_mape", "TOP8 TOP1", ctes("demand day_ahead", f"SELECT ba_code, pairs, mape_pct FROM ({SCORES}) WHERE NOT is_total"))
def _(b):
    per_key = rollups.score_sets(_score_pairs(b)).where("NOT is_total").select("ba_code", "pairs", "mape_pct")
    return rounded(ranking.order_by(per_key, "mape_pct asc nulls last", "ba_code"))


# --- trailing trim ----------------------------------------------------------------------------

LAGGED = """SELECT date_trunc('hour', ts) AS period_utc, count(DISTINCT event_type) AS bas,
 sum(CASE WHEN ts > (SELECT max(ts) FROM events) - INTERVAL 90 MINUTE THEN value * 0.1 ELSE value END) AS mwh FROM events GROUP BY 1"""
TRIM_CTES = {
    "buckets": LAGGED,
    "ranked": """SELECT *, row_number() OVER (ORDER BY period_utc DESC) AS rn, count(*) OVER () AS n,
 CASE WHEN bas < 0.9 * (SELECT median(bas) FROM buckets) OR mwh < 0.6 * (SELECT median(mwh) FROM buckets) THEN 1 ELSE 0 END AS inc FROM buckets""",
    "run": "SELECT *, min(inc) OVER (ORDER BY rn) AS bad FROM ranked",
}


def _lagged(b):
    """Hourly totals whose last hours are under-reported, as with a feed that publishes late."""
    late = F.col("ts") > b.weather_now - F.expr("INTERVAL '90' MINUTE")
    value = F.when(late, F.col("value") * 0.1).otherwise(F.col("value"))
    hour = F.window("ts", "1 hour")["start"].alias("period_utc")
    return b.table("events").groupBy(hour).agg(F.countDistinct("event_type").alias("bas"), F.sum(value).alias("mwh"))


@query(
    "trim_incomplete_tail",
    "DQ10",
    ctes("", "SELECT period_utc, bas, round(mwh, 4) AS mwh FROM run WHERE NOT (bad = 1 AND rn <= least(3, n - 2))", **TRIM_CTES),
)
def _(b):
    return rounded(ranking.drop_incomplete_tail(_lagged(b), "period_utc", "bas", "mwh"))


@query(
    "incomplete_tail",
    "DQ10",
    ctes(
        "",
        """SELECT CAST(count(*) FILTER (WHERE bad = 1 AND rn <= least(3, n - 2)) AS INTEGER) AS n_trimmed,
 min(period_utc) FILTER (WHERE bad = 1 AND rn <= least(3, n - 2)) AS trim_from FROM run""",
        **TRIM_CTES,
    ),
)
def _(b):
    return ranking.incomplete_tail(_lagged(b), "period_utc", "bas", "mwh")


@query(
    "trim_per_key",
    "DQ10",
    ctes(
        "zone_load",
        """SELECT bidding_zone, period_utc, value_mw FROM run WHERE NOT (bad = 1 AND rn <= least(3, n - 2) AND n >= 4)""",
        ranked="""SELECT *, row_number() OVER (PARTITION BY bidding_zone ORDER BY period_utc DESC) AS rn, count(*) OVER (PARTITION BY bidding_zone) AS n,
 CASE WHEN value_mw < 0.6 * m THEN 1 ELSE 0 END AS inc FROM zone_load JOIN (SELECT bidding_zone, median(value_mw) AS m FROM zone_load GROUP BY 1) USING (bidding_zone)""",
        run="SELECT *, min(inc) OVER (PARTITION BY bidding_zone ORDER BY rn) AS bad FROM ranked",
    ),
)
def _(b):
    rows = b.zone_load.withColumn("n", F.lit(1))
    return ranking.drop_incomplete_tail(rows, "period_utc", "n", "value_mw", ["bidding_zone"]).drop("n")


@query(
    "generation_bundle_series",
    "TOP4 DQ10",
    ctes(
        "generation fuels snow",
        """SELECT period_utc, band, sum(value_mwh) AS value_mwh FROM recent JOIN bands USING (fuel_code)
 WHERE period_utc NOT IN (SELECT period_utc FROM run WHERE bad = 1 AND rn <= least(3, n - 2)) GROUP BY 1, 2""",
        **BAND_CTES,
        recent="SELECT period_utc, fuel_code, sum(value_mwh) AS value_mwh FROM generation, snow WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY 1, 2",
        buckets="SELECT period_utc, count(*) AS bas, sum(value_mwh) AS mwh FROM recent GROUP BY 1",
        ranked=TRIM_CTES["ranked"],
        run=TRIM_CTES["run"],
    ),
)
def _(b):
    return reports.generation_bundle(b.generation, b.fuels, 168)["series"]


@query(
    "europe_bundle_series",
    "TOP3 AGG15 DQ10",
    ctes(
        "zone_load snow",
        """SELECT period_utc, CASE WHEN r.rn <= 6 THEN bidding_zone ELSE 'Other' END AS band, sum(value_mw) AS value_mw
 FROM recent JOIN (SELECT bidding_zone, row_number() OVER (ORDER BY avg(value_mw) DESC, bidding_zone) AS rn FROM recent GROUP BY 1) r USING (bidding_zone)
 WHERE period_utc NOT IN (SELECT period_utc FROM run WHERE bad = 1 AND rn <= least(3, n - 2)) GROUP BY 1, 2""",
        recent="SELECT period_utc, bidding_zone, value_mw FROM zone_load, snow WHERE period_utc > now - INTERVAL 168 HOUR",
        buckets="SELECT period_utc, count(*) AS bas, sum(value_mw) AS mwh FROM recent GROUP BY 1",
        ranked=TRIM_CTES["ranked"],
        run=TRIM_CTES["run"],
    ),
)
def _(b):
    return reports.europe_bundle(b.zone_load, 168, b.shipped_now)["series"]


# --- sets -------------------------------------------------------------------------------------


@query(
    "union_of_keys",
    "SET2",
    "SELECT DISTINCT s_nationkey AS k FROM supplier UNION SELECT DISTINCT c_nationkey FROM customer",
)
def _(b):
    return ranking.union_keys(
        b.table("supplier").select(F.col("s_nationkey").alias("k")), b.table("customer").select(F.col("c_nationkey").alias("k")), "k"
    )


@query(
    "distinct_endpoints",
    "SET3",
    ctes("interchange", "SELECT count(DISTINCT ba) AS distinct_bas FROM (SELECT from_ba AS ba FROM interchange UNION ALL SELECT to_ba FROM interchange)"),
)
def _(b):
    return ranking.endpoints_distinct(b.interchange)


@query(
    "union_of_series",
    "SET4",
    ctes("demand_long", "SELECT period_utc, ba_code, series, value_mwh FROM demand_long"),
)
def _(b):
    long = b.demand_long
    return ranking.union_all(*[long.where(F.col("series") == s) for s in ("D", "NG", "TI")])
