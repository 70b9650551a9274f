"""Freshness, plausibility, balance and column tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlake import reference_data as ref
from hourlake.operators import filters, quality, ranking, rollups
from hourlake.queries.bases import fct_demand, FCT_DEMAND
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import query, rounded

LONG_LIMITS = {"from_h": 720, "to_h": 3}

STALE = {
    "aged": """SELECT f.source, date_diff('second', last_fetch_utc, now) / 3600.0 AS fh, date_diff('second', last_period_utc, now) / 3600.0 AS ph,
 CASE WHEN s.source IS NULL THEN 3.0 ELSE fetch_sla_h END AS fs, s.period_sla_h AS ps
 FROM freshness f LEFT JOIN sla s ON s.source = f.source, onow""",
    "reasons": f"""SELECT source, CASE WHEN fh IS NULL THEN '{ref.NEVER_FETCHED}' WHEN fh > fs
 THEN printf('{ref.FETCH_TOO_OLD}', CAST(fh AS DOUBLE), CAST(fs AS DOUBLE)) END AS r1,
 CASE WHEN ph > ps THEN printf('{ref.DATA_TOO_OLD}', CAST(ph AS DOUBLE), CAST(ps AS DOUBLE)) END AS r2 FROM aged""",
    "stale": "SELECT source, r1 IS NOT NULL OR r2 IS NOT NULL AS is_stale, nullif(concat_ws('; ', r1, r2), '') AS stale_reason FROM reasons",
}


@query("source_staleness", "DQ1 PRJ13", ctes("freshness onow sla", "SELECT source, is_stale, stale_reason FROM stale", **STALE))
def _(b):
    return quality.staleness(b.freshness, b.sla, b.ops_now).select("source", "is_stale", "stale_reason")


FRESH_CHECK = f"""SELECT 'freshness' AS name, CASE WHEN stale = 0 THEN 'pass' WHEN stale = sources THEN 'fail' ELSE 'warn' END AS status,
 printf('{ref.FRESH_SOURCES}', sources - stale, sources) AS value, sources, sources - stale AS fresh, stale
 FROM (SELECT count(*) AS sources, count(*) FILTER (WHERE is_stale) AS stale FROM stale)"""


@query("check_freshness", "DQ2", ctes("freshness onow sla", FRESH_CHECK, **STALE))
def _(b):
    return quality.check_freshness(b.freshness, b.sla, b.ops_now)


PLAUSIBLE = f"""SELECT 'demand_plausibility' AS name, CASE WHEN (nulls + np) / obs > 0.02 THEN 'fail' WHEN nulls + np > 0 THEN 'warn' ELSE 'pass' END AS status,
 printf('{ref.DEMAND_COUNTS}', obs, nulls, np) AS value, obs AS observations, nulls, np AS non_positive, bas
 FROM (SELECT count(*) AS obs, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) FILTER (WHERE v <= 0) AS np, count(DISTINCT ba_code) AS bas
 FROM (SELECT ba_code, CASE WHEN value_mwh < 20 THEN NULL ELSE value_mwh - 21 END AS v FROM demand, dnow WHERE period_utc > now - INTERVAL 24 HOUR))"""


@query("check_plausibility", "DQ3 AGG18", ctes("dnow", PLAUSIBLE))
def _(b):
    v = F.col("value_mwh")
    spoiled = b.demand.withColumn("value_mwh", F.when(v >= 20, v - 21))
    return quality.check_plausibility(spoiled, b.demand_now)


BALANCE = """SELECT ba_code, CASE WHEN abs(res / d * 100) > 10 THEN 'warn' ELSE 'pass' END AS status, round(d, 1) AS demand_mwh,
 round(ng, 1) AS net_generation_mwh, round(ti, 1) AS total_interchange_mwh, round(res, 1) AS residual_mwh, round(res / d * 100, 2) AS residual_pct, hours
 FROM (SELECT ba_code, sum(d) AS d, sum(ng) AS ng, sum(ti) AS ti, sum(ng) - sum(ti) - sum(d) AS res, count(*) AS hours FROM
 (SELECT period_utc, ba_code, max(value_mwh) FILTER (WHERE series = 'D') AS d, max(value_mwh) FILTER (WHERE series = 'NG') AS ng,
 max(value_mwh) FILTER (WHERE series = 'TI') AS ti FROM demand_long, snow
 WHERE period_utc > now - INTERVAL 720 HOUR AND period_utc <= now - INTERVAL 3 HOUR GROUP BY 1, 2)
 WHERE d IS NOT NULL AND ng IS NOT NULL AND ti IS NOT NULL GROUP BY 1) WHERE d <> 0"""


@query("energy_balance", "DQ4 AGG19 PRJ5", ctes("demand_long snow", BALANCE))
def _(b):
    return quality.energy_balance(b.demand_long, b.shipped_now, **LONG_LIMITS)


FUELS = """SELECT ba_code, CASE WHEN abs(res / ng * 100) > 10 THEN 'warn' ELSE 'pass' END AS status, round(fuel, 1) AS fuel_sum_mwh,
 round(ng, 1) AS net_generation_mwh, round(res, 1) AS residual_mwh, round(res / ng * 100, 2) AS residual_pct, hours
 FROM (SELECT ba_code, sum(fuel) AS fuel, sum(ng) AS ng, sum(fuel) - sum(ng) AS res, count(*) AS hours FROM
 (SELECT period_utc, ba_code, max(value_mwh) AS ng FROM demand_long, snow WHERE series = 'NG' AND period_utc > now - INTERVAL 720 HOUR
 AND period_utc <= now - INTERVAL 3 HOUR GROUP BY 1, 2) JOIN (SELECT period_utc, ba_code, sum(value_mwh) AS fuel FROM generation_regional, snow
 WHERE period_utc > now - INTERVAL 720 HOUR AND period_utc <= now - INTERVAL 3 HOUR GROUP BY 1, 2) USING (period_utc, ba_code) GROUP BY 1) WHERE ng <> 0"""


@query("fuel_reconciliation", "DQ5 JON6", ctes("demand_long generation_regional snow", FUELS))
def _(b):
    return quality.fuel_reconciliation(b.demand_long, b.generation_regional, b.shipped_now, **LONG_LIMITS)


@query(
    "reconciliation_problems",
    "TOP9",
    ctes("demand_long generation_regional snow", "SELECT ba_code, status, residual_pct FROM fuel WHERE status <> 'pass'", fuel=FUELS),
)
def _(b):
    details = quality.fuel_reconciliation(b.demand_long, b.generation_regional, b.shipped_now, **LONG_LIMITS)
    return ranking.problems(details, ties=["ba_code"]).select("ba_code", "status", "residual_pct")


def _rollup_check(name: str, details: str) -> str:
    return f"""SELECT '{name}' AS name, CASE WHEN flagged > 0 THEN 'warn' ELSE 'pass' END AS status,
 CASE WHEN n = 0 THEN '{ref.NOTHING_SETTLED}' WHEN flagged = 0 THEN printf('{ref.ALL_RECONCILE}', n)
 ELSE printf('{ref.SOME_RECONCILE}', n - flagged, n, flagged) END AS value
 FROM (SELECT count(*) AS n, count(*) FILTER (WHERE status <> 'pass') AS flagged FROM {details})"""


@query(
    "check_energy_balance",
    "DQ4 AGG28",
    ctes("demand_long snow", _rollup_check("energy_balance", "details"), details=BALANCE),
)
def _(b):
    return quality.check_energy_balance(b.demand_long, b.shipped_now, **LONG_LIMITS)


@query(
    "check_fuel_shares",
    "DQ5 AGG28",
    ctes("demand_long generation_regional snow", _rollup_check("fuel_shares", "details"), details=FUELS),
)
def _(b):
    return quality.check_fuel_shares(b.demand_long, b.generation_regional, b.shipped_now, **LONG_LIMITS)


VALIDATION = {
    **STALE,
    "bal": BALANCE,
    "fuel": FUELS,
    "c1": FRESH_CHECK,
    "c2": f"""SELECT 'demand_plausibility' AS name, 'pass' AS status, printf('{ref.DEMAND_COUNTS}', obs, 0, 0) AS value, obs AS observations, bas
 FROM (SELECT count(*) AS obs, count(DISTINCT ba_code) AS bas FROM demand_long, snow WHERE series = 'D' AND period_utc > now - INTERVAL 24 HOUR)""",
    "c3": _rollup_check("energy_balance", "bal"),
    "c4": _rollup_check("fuel_shares", "fuel"),
    "checks": """SELECT name, status, value, sources, fresh, stale, CAST(NULL AS BIGINT) AS observations, CAST(NULL AS BIGINT) AS nulls,
 CAST(NULL AS BIGINT) AS non_positive, CAST(NULL AS BIGINT) AS bas FROM c1
 UNION ALL SELECT name, status, value, NULL, NULL, NULL, observations, 0, 0, bas FROM c2
 UNION ALL SELECT name, status, value, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c3
 UNION ALL SELECT name, status, value, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c4""",
}
ROLES = "freshness onow sla demand_long generation_regional snow"


def _report(b):
    return quality.validation_report(
        b.demand_long, b.generation_regional, b.freshness, b.sla, b.shipped_now, b.ops_now, **LONG_LIMITS
    )


@query(
    "validation_report",
    "DQ11 DQ2 DQ3 DQ4 DQ5",
    ctes(ROLES, "SELECT *, (SELECT max(period_utc) FROM demand_long WHERE series = 'D') AS as_of_utc FROM checks", **VALIDATION),
)
def _(b):
    return _report(b)


@query(
    "validation_summary",
    "AGG28 DQ11",
    ctes(
        ROLES,
        """SELECT count(*) FILTER (WHERE status = 'pass') AS "pass", count(*) FILTER (WHERE status = 'warn') AS warn,
 count(*) FILTER (WHERE status = 'fail') AS fail FROM checks""",
        **VALIDATION,
    ),
)
def _(b):
    return rollups.status_counts(_report(b))


@query(
    "source_priority",
    "DQ6",
    ctes(
        "demand_raw",
        """SELECT period_utc, ba_code, series, source, round(value_mwh, 4) AS value_mwh FROM (SELECT *, row_number() OVER (
 PARTITION BY period_utc, ba_code, series ORDER BY CASE source WHEN 'EIA' THEN 1 WHEN 'DEMO' THEN 2 ELSE 3 END) AS rn FROM demand_raw) WHERE rn = 1""",
    ),
)
def _(b):
    best = quality.resolve_source(b.demand_raw, ["period_utc", "ba_code", "series"], ["EIA", "DEMO"])
    return rounded(best.select("period_utc", "ba_code", "series", "source", "value_mwh"))


@query(
    "column_tests",
    "DQ7",
    ctes(
        "demand day_ahead",
        """SELECT test, failures, CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status FROM (
 SELECT 'not_null_period_utc' AS test, count(*) FILTER (WHERE period_utc IS NULL) AS failures FROM fct
 UNION ALL SELECT 'not_null_forecast_mwh', count(*) FILTER (WHERE forecast_mwh IS NULL) FROM fct
 UNION ALL SELECT 'demand_not_negative', count(*) FILTER (WHERE NOT (demand_mwh >= 0 OR demand_mwh IS NULL)) FROM fct
 UNION ALL SELECT 'unique_ba_code', count(*) FROM (SELECT ba_code FROM fct GROUP BY 1 HAVING count(*) > 1))""",
        fct=FCT_DEMAND,
    ),
)
def _(b):
    return quality.column_tests(
        fct_demand(b), ["period_utc", "forecast_mwh"], ["ba_code"], {"demand_not_negative": "demand_mwh >= 0 OR demand_mwh IS NULL"}
    )


@query(
    "load_freshness",
    "DQ8",
    """SELECT last_loaded, age_hours, CASE WHEN age_hours > 24 THEN 'error' WHEN age_hours > 6 THEN 'warn' ELSE 'pass' END AS status
 FROM (SELECT max(o_orderdate) AS last_loaded, CAST(date_diff('second', max(o_orderdate), (SELECT max(l_shipdate) FROM lineitem)) / 3600.0 AS DOUBLE) AS age_hours FROM orders)""",
)
def _(b):
    return quality.freshness_test(b.table("orders"), "o_orderdate", b.shipped_now)


SIMPLE = """SELECT source, CAST(date_diff('second', last_fetch_utc, now) AS DOUBLE) AS sec_since_fetch, CASE WHEN trim(coalesce(last_error, '')) <> '' THEN 'error'
 WHEN last_fetch_utc IS NULL OR date_diff('second', last_fetch_utc, now) > 10800 THEN 'stale' ELSE 'ok' END AS status FROM freshness, onow"""


@query("simple_source_status", "DQ9", ctes("freshness onow", SIMPLE))
def _(b):
    return quality.simple_status(filters.with_ages(b.freshness, b.ops_now)).select("source", "sec_since_fetch", "status")


@query(
    "source_status_summary",
    "DQ9 AGG21",
    ctes(
        "freshness onow",
        """SELECT count(*) FILTER (WHERE status = 'ok') AS healthy, count(*) FILTER (WHERE status <> 'ok') AS issues,
 arg_max(source, sec_since_fetch) AS most_stale FROM simple""",
        simple=SIMPLE,
    ),
)
def _(b):
    return quality.status_summary(quality.simple_status(filters.with_ages(b.freshness, b.ops_now)))
