"""Lags, rolling frames, fills, latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hourlake.functions.times import bucket_start
from hourlake.operators import windows
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import query, rounded

HEADLINE = """SELECT max(period_utc) FILTER (WHERE rn = 1) AS as_of_utc, round(sum(value_mwh) FILTER (WHERE rn = 1), 4) AS total_mwh_now,
 round(sum(day_ago) FILTER (WHERE rn = 1), 4) AS total_mwh_24h_ago, count(DISTINCT ba_code) FILTER (WHERE rn = 1) AS bas,
 round((sum(value_mwh) FILTER (WHERE rn = 1) - sum(day_ago) FILTER (WHERE rn = 1)) / nullif(sum(day_ago) FILTER (WHERE rn = 1), 0) * 100, 4) AS delta_pct
 FROM (SELECT *, lag(value_mwh, 24) OVER (PARTITION BY ba_code ORDER BY period_utc) AS day_ago,
 row_number() OVER (PARTITION BY ba_code ORDER BY period_utc DESC) AS rn FROM demand, dnow WHERE period_utc > now - INTERVAL 48 HOUR)"""


@query("demand_headline", "WIN1 WIN2 WIN3", ctes("dnow", HEADLINE))
def headline(b):
    return rounded(windows.demand_headline(b.demand, b.demand_now))


@query(
    "demand_headline_aligned",
    "WIN3",
    ctes(
        "dnow",
        """SELECT max(now) AS as_of_utc, round(sum(value_mwh) FILTER (WHERE period_utc = now), 4) AS total_mwh_now,
 round(sum(value_mwh) FILTER (WHERE period_utc = now - INTERVAL 24 HOUR), 4) AS total_mwh_24h_ago,
 count(DISTINCT ba_code) FILTER (WHERE period_utc = now) AS bas,
 round((sum(value_mwh) FILTER (WHERE period_utc = now) - sum(value_mwh) FILTER (WHERE period_utc = now - INTERVAL 24 HOUR))
 / nullif(sum(value_mwh) FILTER (WHERE period_utc = now - INTERVAL 24 HOUR), 0) * 100, 4) AS delta_pct FROM demand, dnow""",
    ),
)
def _(b):
    return rounded(windows.demand_headline(b.demand, b.demand_now, aligned=True))


@query(
    "lags_by_rows",
    "WIN1",
    ctes(
        "demand",
        """SELECT period_utc, ba_code, round(value_mwh, 4) AS value_mwh,
 round(lag(value_mwh, 1) OVER w, 4) AS lag_1, round(lag(value_mwh, 24) OVER w, 4) AS lag_24
 FROM demand WINDOW w AS (PARTITION BY ba_code ORDER BY period_utc)""",
    ),
)
def _(b):
    return rounded(windows.with_lags(b.demand, ["ba_code"], "period_utc", "value_mwh", [1, 24], block_rows=200))


@query(
    "lags_by_time",
    "WIN1",
    ctes(
        "demand",
        """SELECT d.period_utc, d.ba_code, round(d.value_mwh, 4) AS value_mwh, round(p.value_mwh, 4) AS lag_1, round(q.value_mwh, 4) AS lag_24
 FROM demand d LEFT JOIN demand p ON p.ba_code = d.ba_code AND p.period_utc = d.period_utc - INTERVAL 1 HOUR
 LEFT JOIN demand q ON q.ba_code = d.ba_code AND q.period_utc = d.period_utc - INTERVAL 24 HOUR""",
    ),
)
def _(b):
    return rounded(windows.with_lags(b.demand, ["ba_code"], "period_utc", "value_mwh", [1, 24], by="time"))


@query(
    "row_numbers_in_pieces",
    "WIN1 WIN6",
    """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS nth FROM events""",
)
def _(b):
    rows = b.table("events").select("event_id", "event_type", "ts")
    return windows.number_rows(rows, ["event_type"], "ts", "nth", "1 day").select("event_id", "event_type", F.col("nth").cast("long"))


@query(
    "latest_per_key",
    "WIN2",
    """SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
 WHERE rn = 1""",
)
def _(b):
    rows = b.table("events").select("user_id", "event_id", "ts", "value")
    return windows.latest_per(rows, ["user_id"], "ts", ["event_id"])


@query(
    "nearest_reading",
    "WIN4",
    ctes(
        "weather",
        """SELECT station_id, period_utc, temperature_c FROM (SELECT *, row_number() OVER (PARTITION BY station_id
 ORDER BY abs(epoch_us(period_utc) - epoch_us(now)), period_utc DESC) AS rn
 FROM (SELECT *, (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AS now FROM weather) WHERE period_utc > now - INTERVAL 6 HOUR) WHERE rn = 1""",
    ),
)
def _(b):
    now = b.table("events").agg(F.max("ts") - F.expr("INTERVAL '48' HOUR")).scalar()
    rows = windows.latest_readings(b.weather, now, mode="nearest")
    return rows.select("station_id", "period_utc", "temperature_c")


@query(
    "latest_vintage",
    "WIN5",
    ctes(
        "vintages",
        """SELECT period_utc, ba_code, round(yhat_mwh, 4) AS yhat_mwh, model_name, fit_at_utc FROM (SELECT *,
 row_number() OVER (PARTITION BY ba_code, period_utc ORDER BY fit_at_utc DESC) AS rn FROM vintages) WHERE rn = 1""",
    ),
)
def _(b):
    latest = windows.latest_vintage(b.vintages, ["ba_code", "period_utc"])
    return rounded(latest.select("period_utc", "ba_code", "yhat_mwh", "model_name", "fit_at_utc"))


def _rolling_sql(expr: str, frame: str) -> str:
    return ctes(
        "demand",
        f"""SELECT period_utc, ba_code, round(value_mwh, 9) AS value_mwh,
 round(CASE WHEN count(value_mwh) OVER w >= 24 THEN {expr} END, 9) AS rolled
 FROM demand WINDOW w AS (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN {frame})""",
    )


@query("rolling_mean", "WIN6", _rolling_sql("avg(value_mwh) OVER w", "167 PRECEDING AND CURRENT ROW"))
def _(b):
    return rounded(windows.rolling(b.demand, ["ba_code"], "period_utc", "value_mwh", "avg", into="rolled", block_rows=200), 9)


@query("rolling_mean_shifted", "WIN7", _rolling_sql("avg(value_mwh) OVER w", "168 PRECEDING AND 1 PRECEDING"))
def _(b):
    return rounded(windows.rolling(b.demand, ["ba_code"], "period_utc", "value_mwh", "avg", shift=1, into="rolled"), 9)


@query("rolling_deviation", "WIN8", _rolling_sql("nullif(stddev_samp(value_mwh) OVER w, 0)", "167 PRECEDING AND CURRENT ROW"))
def _(b):
    return rounded(windows.rolling(b.demand, ["ba_code"], "period_utc", "value_mwh", "stddev_samp", into="rolled", block_rows=200), 9)


HOLES = "SELECT period_utc, ba_code, CASE WHEN value_mwh < 120 THEN NULL ELSE value_mwh END AS v FROM demand"


def _holes(b):
    v = F.col("value_mwh")
    return b.demand.select("period_utc", "ba_code", F.when(v >= 120, v).alias("v"))


@query(
    "fill_back_then_forward",
    "WIN9",
    ctes(
        "demand",
        """SELECT period_utc, ba_code, round(coalesce(v,
 first_value(v IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
 last_value(v IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS v FROM holes""",
        holes=HOLES,
    ),
)
def _(b):
    return rounded(windows.fill(_holes(b), ["ba_code"], "period_utc", "v", "bf", piece="3 days"))


@query(
    "interpolate_in_time",
    "WIN10",
    ctes(
        "demand",
        """SELECT period_utc, ba_code, round(coalesce(v, v0 + (v1 - v0) * date_diff('second', t0, period_utc) / nullif(date_diff('second', t0, t1), 0)), 9) AS v
 FROM (SELECT *, last_value(v IGNORE NULLS) OVER p AS v0, first_value(v IGNORE NULLS) OVER n AS v1,
 last_value(CASE WHEN v IS NOT NULL THEN period_utc END IGNORE NULLS) OVER p AS t0,
 first_value(CASE WHEN v IS NOT NULL THEN period_utc END IGNORE NULLS) OVER n AS t1 FROM holes
 WINDOW p AS (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 n AS (PARTITION BY ba_code ORDER BY period_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        holes=HOLES,
    ),
)
def _(b):
    return rounded(windows.interpolate(_holes(b), ["ba_code"], "period_utc", "v", piece="3 days"), 9)


@query(
    "last_rows_per_key",
    "WIN11",
    """SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 24""",
)
def _(b):
    return windows.tail_per(b.table("events").select("user_id", "event_id", "ts"), ["user_id"], "ts", 24)


@query(
    "percent_of_peak",
    "WIN12",
    ctes(
        "demand day_ahead",
        """SELECT ba_code, period_utc, round(CASE WHEN peak > 0 AND actual >= 0 THEN actual / peak * 100 END, 4) AS actual_pct,
 round(CASE WHEN peak > 0 AND yhat >= 0 THEN yhat / peak * 100 END, 4) AS yhat_pct
 FROM (SELECT *, greatest(max(actual) FILTER (WHERE actual >= 0) OVER (PARTITION BY ba_code), max(yhat) FILTER (WHERE yhat >= 0) OVER (PARTITION BY ba_code)) AS peak
 FROM (SELECT ba_code, period_utc, d.value_mwh - 60 AS actual, f.value_mwh - 80 AS yhat FROM demand d FULL OUTER JOIN day_ahead f USING (ba_code, period_utc)))""",
    ),
)
def _(b):
    keys = ["ba_code", "period_utc"]
    a = b.demand.select(*keys, (F.col("value_mwh") - 60).alias("actual"))
    y = b.day_ahead.select(*keys, (F.col("value_mwh") - 80).alias("yhat"))
    out = windows.pct_of_peak(a.join(y, keys, "full_outer"))
    return rounded(out.select(*keys, "actual_pct", "yhat_pct"))


@query(
    "scaled_temperatures",
    "WIN13",
    """SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) /
 ((SELECT max(c_acctbal) FROM customer) - (SELECT min(c_acctbal) FROM customer)), 6) AS scaled FROM customer""",
)
def _(b):
    scaled = windows.minmax01(b.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "scaled")
    return rounded(scaled.select("c_custkey", "scaled"), 6)


@query(
    "hourly_buckets",
    "AGG1 WIN9",
    "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1",
)
def _(b):
    return b.table("events").groupBy(bucket_start("ts", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
