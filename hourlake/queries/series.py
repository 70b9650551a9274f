"""Grid, forecasts, anomaly scores, accuracy, mix shift."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from hourlake.operators import arma, filters, forecast, ranking, rollups
from hourlake.plans import scoring
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import query, rounded
from hourlake.session import shared_dir

GRID = {
    "hist": "SELECT ba_code, period_utc, value_mwh FROM demand, dnow WHERE period_utc > now - INTERVAL 336 HOUR",
    "spans": "SELECT ba_code, min(period_utc) AS a, max(period_utc) AS z FROM hist GROUP BY 1 HAVING count(*) >= 72",
    "hours": "SELECT ba_code, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS period_utc FROM spans",
    "numbered": """SELECT h.ba_code, h.period_utc, value_mwh AS v0,
 row_number() OVER (PARTITION BY h.ba_code ORDER BY h.period_utc) AS i FROM hours h LEFT JOIN hist USING (ba_code, period_utc)""",
    "grid": """SELECT ba_code, period_utc, coalesce(v0, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0)) AS v FROM (SELECT *,
 last_value(v0 IGNORE NULLS) OVER p AS pv, first_value(v0 IGNORE NULLS) OVER n AS nv,
 last_value(CASE WHEN v0 IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi,
 first_value(CASE WHEN v0 IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni FROM numbered
 WINDOW p AS (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
}
AR1 = {
    "prof": "SELECT ba_code, hour(period_utc) AS h, avg(v) AS m FROM grid GROUP BY 1, 2",
    "resid": "SELECT g.ba_code, period_utc, v - m AS u FROM grid g JOIN prof p ON p.ba_code = g.ba_code AND p.h = hour(period_utc)",
    "lagged": "SELECT *, lag(u) OVER (PARTITION BY ba_code ORDER BY period_utc) AS u1 FROM resid",
    "phis": """SELECT ba_code, greatest(-0.99, least(0.99, regr_slope(u, u1))) AS phi, max(period_utc) AS last_utc,
 arg_max(u, period_utc) AS ulast FROM lagged GROUP BY 1""",
    "sig": "SELECT ba_code, stddev_samp(u - phi * u1) AS sigma FROM lagged JOIN phis USING (ba_code) GROUP BY 1",
    "ar1": """SELECT last_utc + to_hours(n) AS period_utc, phis.ba_code, m + power(phi, n) * ulast AS yhat,
 1.2816 * sigma * sqrt((1 - power(phi, 2 * n)) / (1 - phi * phi)) AS half
 FROM phis JOIN sig ON sig.ba_code = phis.ba_code
 CROSS JOIN (SELECT CAST(unnest(generate_series(1, 24)) AS INTEGER) AS n) s
 JOIN prof ON prof.ba_code = phis.ba_code AND h = (hour(last_utc) + n) % 24""",
}


@query(
    "regular_grid",
    "FC1 WIN10",
    ctes("dnow", "SELECT ba_code, period_utc, round(v, 4) AS value_mwh FROM grid", **GRID),
)
def _(b):
    return rounded(forecast.regular_grid(forecast.history(b.demand, b.demand_now)))


@query(
    "seasonal_naive_forecast",
    "FC2 WIN11",
    ctes(
        "dnow",
        """SELECT last_utc + to_hours(n) AS period_utc, t.ba_code, round(v, 4) AS yhat_mwh, round(v - 1.28 * sd, 4) AS yhat_lower,
 round(v + 1.28 * sd, 4) AS yhat_upper, 'seasonal-naive-24h' AS model_name
 FROM lev JOIN tail t ON t.ba_code = lev.ba_code CROSS JOIN (SELECT CAST(unnest(generate_series(1, 24)) AS INTEGER) AS n) s
 WHERE rn = 24 - (n - 1) % 24""",
        **GRID,
        tail="SELECT *, row_number() OVER (PARTITION BY ba_code ORDER BY period_utc DESC) AS rn FROM grid",
        lev="SELECT ba_code, max(period_utc) AS last_utc, coalesce(nullif(stddev_pop(v), 0), 1) AS sd FROM tail WHERE rn <= 168 GROUP BY 1",
    ),
)
def _(b):
    return rounded(forecast.seasonal_naive(b.demand, b.demand_now))


@query(
    "seasonal_ar1_forecast",
    "FC3",
    ctes(
        "dnow",
        """SELECT period_utc, ba_code, round(yhat, 4) AS yhat_mwh, round(yhat - half, 4) AS yhat_lower, round(yhat + half, 4) AS yhat_upper,
 'seasonal-ar1-24h' AS model_name FROM ar1""",
        **GRID,
        **AR1,
    ),
)
def _(b):
    return rounded(forecast.seasonal_ar1(b.demand, b.demand_now))


@query(
    "forecast_vintage",
    "FC4 FC3",
    ctes(
        "dnow",
        """SELECT period_utc, ba_code, round(yhat, 4) AS yhat_mwh, round(yhat - half, 4) AS yhat_lower, round(yhat + half, 4) AS yhat_upper,
 'seasonal-ar1-24h' AS model_name, now AS fit_at_utc FROM ar1, dnow""",
        **GRID,
        **AR1,
    ),
)
def _(b):
    return rounded(forecast.demand_forecast(b.demand, b.demand_now))


@query(
    "forecast_model_report",
    "FC4",
    ctes("dnow", "SELECT 'seasonal-ar1-24h' AS model_name, count(DISTINCT ba_code) AS keys FROM hist", hist=GRID["hist"]),
)
def _(b):
    vintage = forecast.demand_forecast(b.demand, b.demand_now)
    return forecast.model_report(b.demand, vintage, b.demand_now)


SCAN = {
    "dh": "SELECT ba_code, hour(period_utc) AS h, avg(v) AS m FROM grid GROUP BY 1, 2",
    "dm": "SELECT ba_code, avg(m) AS mm FROM dh GROUP BY 1",
    "raw": """SELECT g.ba_code, g.period_utc, g.v, CASE WHEN count(v) OVER w >= 24 THEN avg(v) OVER w * m / mm END AS ex
 FROM grid g JOIN dh ON dh.ba_code = g.ba_code AND dh.h = hour(g.period_utc) JOIN dm ON dm.ba_code = g.ba_code
 WINDOW w AS (PARTITION BY g.ba_code ORDER BY g.period_utc ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)""",
    "exp": """SELECT *, coalesce(first_value(ex IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(ex IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS expected FROM raw""",
    "sds": """SELECT *, v - expected AS res, CASE WHEN count(v - expected) OVER w >= 24 THEN nullif(stddev_samp(v - expected) OVER w, 0) END AS sd0 FROM exp
 WINDOW w AS (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""",
    "zs": """SELECT *, coalesce(res / coalesce(first_value(sd0 IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(sd0 IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 0) AS z,
 row_number() OVER (PARTITION BY ba_code ORDER BY period_utc DESC) AS rn FROM sds""",
    "scan": """SELECT period_utc, ba_code, v AS actual_mwh, expected AS expected_mwh, res AS residual_mwh, z AS z_score, abs(z) >= 2 AS is_anomaly,
 CASE WHEN abs(z) >= 3 THEN 'critical' WHEN abs(z) >= 2 THEN 'warn' ELSE 'info' END AS severity FROM zs WHERE rn <= 24""",
}
SPIKED = "SELECT period_utc, ba_code, CASE WHEN period_utc = now - INTERVAL 5 HOUR THEN value_mwh * 10 ELSE value_mwh END AS value_mwh FROM demand, dnow"
SPIKED_GRID = {"spiked": SPIKED, **GRID, "hist": GRID["hist"].replace("FROM demand", "FROM spiked")}
SCAN_COLUMNS = """period_utc, ba_code, round(actual_mwh, 4) AS actual_mwh, round(expected_mwh, 4) AS expected_mwh,
 round(residual_mwh, 4) AS residual_mwh, round(z_score, 4) AS z_score"""


def _spiked(b):
    """Demand with one recent hour ten times too high."""
    hit = F.col("period_utc") == b.demand_now - F.expr("INTERVAL '5' HOUR")
    return b.demand.withColumn("value_mwh", F.when(hit, F.col("value_mwh") * 10).otherwise(F.col("value_mwh")))


def _scan(b):
    return forecast.anomaly_scan(_spiked(b), b.demand_now)


@query(
    "anomaly_scan",
    "FC5 WIN6 WIN7 WIN8 WIN9 PRJ11",
    ctes("dnow", f"SELECT {SCAN_COLUMNS}, is_anomaly, severity FROM scan", **SPIKED_GRID, **SCAN),
)
def _(b):
    return rounded(_scan(b))


@query(
    "anomalies_recent",
    "PRJ9",
    ctes("dnow", f"SELECT {SCAN_COLUMNS}, severity FROM scan WHERE is_anomaly", **SPIKED_GRID, **SCAN),
)
def _(b):
    return rounded(filters.anomalies_recent(_scan(b), 48, b.demand_now))


@query(
    "anomaly_measures",
    "AGG25 AGG20",
    ctes(
        "dnow",
        """SELECT count(*) FILTER (WHERE is_anomaly) AS flagged, count(*) FILTER (WHERE severity = 'critical') AS critical,
 round(count(*) FILTER (WHERE is_anomaly) / count(*) * 100, 4) AS rate_pct, round(max(abs(z_score)), 4) AS max_abs_z FROM scan""",
        **SPIKED_GRID,
        **SCAN,
    ),
)
def _(b):
    return rounded(rollups.anomaly_measures(_scan(b)))


@query(
    "anomalies_per_key",
    "AGG20",
    ctes("dnow", "SELECT ba_code, count(*) AS n FROM scan WHERE is_anomaly GROUP BY 1", **SPIKED_GRID, **SCAN),
)
def _(b):
    return rollups.count_by(_scan(b).where("is_anomaly"), "ba_code")


def _accuracy_sql(where: str = "TRUE") -> str:
    return ctes(
        "dnow vintages day_ahead",
        """SELECT source, ba_code, grouping(ba_code) = 1 AS is_total, count(*) AS pairs,
 round(avg(abs(a - f) / nullif(a, 0)) * 100, 4) AS mape_pct, round(sqrt(avg(power(a - f, 2))), 4) AS rmse_mwh
 FROM pairs GROUP BY GROUPING SETS ((source), (source, ba_code))""",
        latest="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ba_code, period_utc ORDER BY fit_at_utc DESC) AS rn FROM vintages) WHERE rn = 1""",
        either="SELECT 'model' AS source, ba_code, period_utc, yhat_mwh AS f FROM latest UNION ALL SELECT 'day_ahead', ba_code, period_utc, value_mwh FROM day_ahead",
        pairs=f"""SELECT source, ba_code, value_mwh AS a, f FROM either JOIN demand USING (ba_code, period_utc), dnow
 WHERE period_utc > now - INTERVAL 168 HOUR AND period_utc <= now AND {where}""",
    )


@query("forecast_accuracy", "FC6 WIN5 JON5 AGG16 AGG17", _accuracy_sql())
def _(b):
    return rounded(forecast.forecast_accuracy(b.vintages, b.day_ahead, b.demand, b.demand_now))


@query("forecast_accuracy_one_key", "FC6 PRJ6", _accuracy_sql("ba_code = 'view'"))
def _(b):
    return rounded(forecast.forecast_accuracy(b.vintages, b.day_ahead, b.demand, b.demand_now, ba_code="view"))


VIEW_CTES = {
    "act": "SELECT ba_code, period_utc, value_mwh FROM demand, dnow WHERE period_utc > now - INTERVAL 72 HOUR",
    "fc": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ba_code, period_utc ORDER BY fit_at_utc DESC) AS rn
 FROM vintages, dnow WHERE fit_at_utc > now - INTERVAL 6 HOUR) WHERE rn = 1""",
}


@query(
    "forecast_view",
    "FC7 JON9",
    ctes(
        "dnow vintages",
        """SELECT ba_code, period_utc, round(a.value_mwh, 4) AS actual,
 round(CASE WHEN period_utc = m THEN coalesce(f.yhat_mwh, a.value_mwh) ELSE f.yhat_mwh END, 4) AS yhat,
 round(f.yhat_lower, 4) AS lower, round(f.yhat_upper, 4) AS upper FROM act a FULL OUTER JOIN fc f USING (ba_code, period_utc)
 LEFT JOIN (SELECT ba_code, max(period_utc) AS m FROM act GROUP BY 1) l USING (ba_code)""",
        **VIEW_CTES,
    ),
)
def _(b):
    return rounded(forecast.forecast_view(b.demand, b.vintages, b.demand_now))


@query(
    "forecast_facts",
    "FC7 AGG21",
    ctes(
        "dnow vintages",
        """SELECT ba_code, last_actual_utc, round(last_actual_mwh, 4) AS last_actual_mwh, first_forecast_utc, round(first_yhat_mwh, 4) AS first_yhat_mwh,
 round(peak_yhat_mwh, 4) AS peak_yhat_mwh, peak_utc, coalesce(horizon_hours, 0) AS horizon_hours
 FROM (SELECT ba_code, max(period_utc) AS last_actual_utc, arg_max(value_mwh, period_utc) AS last_actual_mwh FROM act GROUP BY 1)
 FULL OUTER JOIN (SELECT ba_code, min(period_utc) AS first_forecast_utc, arg_min(yhat_mwh, period_utc) AS first_yhat_mwh,
 max(yhat_mwh) AS peak_yhat_mwh, first(period_utc ORDER BY yhat_mwh DESC, period_utc) AS peak_utc, count(*) AS horizon_hours FROM fc GROUP BY 1) USING (ba_code)""",
        **VIEW_CTES,
    ),
)
def _(b):
    return rounded(forecast.forecast_facts(b.demand, b.vintages, b.demand_now))


@query(
    "generation_mix_shift",
    "FC8 PRJ11",
    ctes(
        "generation snow",
        """SELECT ba_code, fuel_code, round(sn, 4) AS share_now, round(sb, 4) AS share_baseline, round(sn - sb, 4) AS shift_pp,
 CASE WHEN abs(sn - sb) >= 10 THEN 'critical' WHEN abs(sn - sb) >= 5 THEN 'warn' ELSE 'info' END AS severity
 FROM (SELECT ba_code, fuel_code, CASE WHEN sum(n) OVER k > 0 THEN n / sum(n) OVER k * 100 END AS sn,
 CASE WHEN sum(o) OVER k > 0 THEN o / sum(o) OVER k * 100 END AS sb FROM parts WINDOW k AS (PARTITION BY ba_code))""",
        parts="""SELECT ba_code, fuel_code, sum(CASE WHEN period_utc > now - INTERVAL 24 HOUR THEN value_mwh ELSE 0 END) AS n,
 sum(CASE WHEN period_utc <= now - INTERVAL 24 HOUR THEN value_mwh ELSE 0 END) AS o FROM generation, snow
 WHERE period_utc > now - INTERVAL 360 HOUR GROUP BY 1, 2""",
    ),
)
def _(b):
    return rounded(forecast.mix_shift(b.generation, b.shipped_now))


@query(
    "custom_forecaster",
    "FC2 FC4",
    ctes(
        "dnow",
        """SELECT last_utc + to_hours(n) AS period_utc, ba_code, round(m, 9) AS yhat_mwh, round(m * 0.9, 9) AS yhat_lower,
 round(m * 1.1, 9) AS yhat_upper, 'last-day-mean' AS model_name
 FROM (SELECT ba_code, max(period_utc) AS last_utc, avg(v) AS m FROM (SELECT *, row_number() OVER (PARTITION BY ba_code ORDER BY period_utc DESC) AS rn FROM grid)
 WHERE rn <= 24 GROUP BY 1) CROSS JOIN (SELECT CAST(unnest(generate_series(1, 24)) AS INTEGER) AS n) s""",
        **GRID,
    ),
)
def _(b):
    """The caller's own forecaster per key: here the mean of the last day with a fixed band."""

    def last_day_mean(values, horizon):
        mean = float(values[-24:].mean())
        return [mean] * horizon, [mean * 0.9] * horizon, [mean * 1.1] * horizon

    return rounded(forecast.forecast_with(b.demand, last_day_mean, b.demand_now, model_name="last-day-mean"), 9)


@query(
    "strongest_anomaly",
    "AGG21 TOP9",
    ctes(
        "dnow",
        "SELECT ba_code, period_utc, round(abs(z_score), 4) AS size FROM scan ORDER BY abs(z_score) DESC LIMIT 1",
        **SPIKED_GRID,
        **SCAN,
    ),
)
def _(b):
    rows = _scan(b).select("ba_code", "period_utc", F.abs("z_score").alias("size"))
    return rounded(ranking.top_k(rows, "size", 1, ["ba_code", "period_utc"]))


# --- runs that store their result -------------------------------------------------------------


def _with_odd_keys(b):
    """Demand with a key of ten rows and one whose value never changes."""
    few = b.demand.where("ba_code = 'click'").where(F.col("period_utc") > b.demand_now - F.expr("INTERVAL '10' HOUR")).withColumn("ba_code", F.lit("few"))
    flat = b.demand.where("ba_code = 'view'").withColumns({"ba_code": F.lit("flat"), "value_mwh": F.lit(5.0)})
    return b.demand.unionByName(few).unionByName(flat)


@query(
    "forecast_runs",
    "FC4 FC2 FC3 SNK1",
    ctes(
        "demand dnow",
        """SELECT run, model_name, CAST(keys AS BIGINT) AS keys, CAST(hours AS BIGINT) AS hours, fit_at_utc FROM (
 SELECT run, 'seasonal-ar1-24h' AS model_name, count(DISTINCT ba_code) AS keys, count(DISTINCT ba_code) * 24 AS hours, now - to_hours(back) AS fit_at_utc
 FROM demand, dnow, runs WHERE period_utc <= now - to_hours(back) GROUP BY ALL
 UNION ALL SELECT run, 'seasonal-naive-24h', 1, 24, now - to_hours(back) FROM dnow, runs
 UNION ALL SELECT run, 'none', 1, 0, NULL FROM runs WHERE back = 0)""",
        runs="SELECT * FROM (VALUES (1, 24), (2, 0)) AS v(run, back)",
    ),
)
def _(b):
    """Two vintages, each stored twice. The key of ten rows gets no forecast, the constant one the seasonal pattern."""
    path, demand, reports = shared_dir(b.spark, "vintages"), _with_odd_keys(b), []
    for run, back in ((1, 24), (2, 0)):
        end = b.demand_now - F.make_dt_interval(hours=F.lit(back))
        seen = demand.where(F.col("period_utc") <= end)
        for _ in range(2):
            report = scoring.store_forecast(seen, path, end)
        reports.append(report.select(F.lit(run).alias("run"), "model_name", "keys"))
    stored = b.spark.read.parquet(path).groupBy("model_name", "fit_at_utc").agg(F.count(F.lit(1)).alias("hours"))
    place = F.dense_rank().over(Window.orderBy("fit_at_utc"))  # two runs
    stored = stored.withColumn("run", place)
    out = reports[0].unionByName(reports[1]).join(stored, ["run", "model_name"], "left")
    return out.withColumn("hours", F.coalesce("hours", F.lit(0)))


@query(
    "anomaly_runs",
    "FC5 SNK1",
    ctes(
        "demand dnow",
        """SELECT ba_code, detected_at, count(*) AS n FROM (SELECT ba_code, h, max(detected_at) AS detected_at FROM (
 SELECT ba_code, unnest(range(24)) AS i, last - to_hours(CAST(i AS INTEGER)) AS h, detected_at FROM ends) GROUP BY 1, 2) GROUP BY 1, 2""",
        ends="""SELECT ba_code, max(period_utc) AS last, now - to_hours(back) AS detected_at FROM demand, dnow, (VALUES (12), (0)) AS v(back)
 WHERE period_utc <= now - to_hours(back) GROUP BY 1, now, back""",
    ),
)
def _(b):
    """Two runs twelve hours apart, the second one repeated: an hour has the scores of the run that saw it last."""
    path = shared_dir(b.spark, "anomalies")
    for back in (12, 0, 0):
        end = b.demand_now - F.make_dt_interval(hours=F.lit(back))
        scoring.store_anomalies(b.demand.where(F.col("period_utc") <= end), path, end)
    return b.spark.read.parquet(path).groupBy("ba_code", "detected_at").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mix_shift_runs",
    "FC8 SNK1",
    ctes(
        "generation snow",
        """SELECT detected_at_utc, count(*) AS n FROM (SELECT DISTINCT now - to_hours(back) AS detected_at_utc, ba_code, fuel_code
 FROM generation, snow, (VALUES (240), (0)) AS v(back) WHERE period_utc > now - to_hours(back + 360) AND period_utc <= now - to_hours(back)) GROUP BY 1""",
    ),
)
def _(b):
    path = shared_dir(b.spark, "shifts")
    for back in (240, 0, 0):
        scoring.store_mix_shift(b.generation, path, b.shipped_now - F.make_dt_interval(hours=F.lit(back)))
    return b.spark.read.parquet(path).groupBy("detected_at_utc").agg(F.count(F.lit(1)).alias("n"))


@query("seasonal_arma_forecast", "FC3 FC4")
def _(b):
    """Two regressions per key; without an SQL counterpart, tests hold the coefficients against plain least squares."""
    return rounded(arma.arma_forecast(b.demand, b.demand_now))
