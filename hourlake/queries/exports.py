"""The export set, written, read back and compared by value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from hourlake.plans import reports
from hourlake.queries.bindings import ctes
from hourlake.queries.registry import query, rounded
from hourlake.queries.series import SCAN, SPIKED_GRID, _scan
from hourlake.session import shared_dir

#: Of each export: a time, up to three names and two numbers.
COLUMNS = {
    "demand_hourly": ("period_utc", "ba_code", None, None, "demand_mwh", "forecast_mwh"),
    "generation_hourly": ("period_utc", "ba_code", "fuel_code", "fuel_name", "generation_mwh", None),
    "renewable_share_hourly": ("period_utc", None, None, None, "total_mwh", "renewable_pct"),
    "source_freshness": ("last_fetch_utc", "source", "last_error", None, "last_rows", "minutes_since_fetch"),
    "balancing_authorities": (None, "ba_code", "ba_name", "region", None, None),
    "anomalies": ("period_utc", "ba_code", "severity", None, "actual_mwh", "z_score"),
    "forecast": ("period_utc", "ba_code", "model_name", None, "yhat_mwh", "yhat_upper"),
    "interchange": ("period_utc", "from_ba", "to_ba", None, "net_mwh", None),
    "ingest_runs": ("started_at", "source", "status", "run_id", "rows_written", None),
    "fuel_types": (None, "fuel_code", "fuel_name", "is_renewable", None, None),
}

EXPORT_SQL = """SELECT 'demand_hourly' AS name, period_utc AS t, ba_code AS k, CAST(NULL AS VARCHAR) AS l, CAST(NULL AS VARCHAR) AS m, round(d.value_mwh, 4) AS a, round(f.value_mwh, 4) AS b
 FROM demand d LEFT JOIN day_ahead f USING (period_utc, ba_code), dnow WHERE period_utc > now - INTERVAL 336 HOUR
 UNION ALL SELECT 'generation_hourly', period_utc, ba_code, fuel_code, coalesce(fuel_name, fuel_code), round(value_mwh, 4), NULL
 FROM generation LEFT JOIN fuels USING (fuel_code), snow WHERE period_utc > now - INTERVAL 168 HOUR
 UNION ALL SELECT 'renewable_share_hourly', period_utc, NULL, NULL, NULL, round(sum(value_mwh), 4), round(sum(value_mwh) FILTER (is_renewable) / nullif(sum(value_mwh), 0) * 100, 4)
 FROM generation LEFT JOIN fuels USING (fuel_code), snow WHERE period_utc > now - INTERVAL 168 HOUR GROUP BY period_utc
 UNION ALL SELECT 'source_freshness', last_fetch_utc, source, last_error, NULL, CAST(last_rows AS DOUBLE),
 round(date_diff('second', last_fetch_utc, max(last_fetch_utc) OVER ()) / 60.0, 4) FROM freshness
 UNION ALL SELECT DISTINCT 'balancing_authorities', CAST(NULL AS TIMESTAMP), ba_code, ba_code, 'Unknown', NULL, NULL FROM demand
 UNION ALL SELECT 'anomalies', period_utc, ba_code, severity, NULL, round(actual_mwh, 4), round(z_score, 4) FROM scan
 UNION ALL SELECT 'forecast', period_utc, ba_code, model_name, NULL, round(yhat_mwh, 4), round(yhat_upper, 4) FROM vintages, dnow WHERE fit_at_utc > now - INTERVAL 24 HOUR
 UNION ALL SELECT 'interchange', period_utc, from_ba, to_ba, NULL, round(value_mwh, 4), NULL FROM interchange, snow WHERE period_utc > now - INTERVAL 168 HOUR
 UNION ALL SELECT 'ingest_runs', started_at, source, status, CAST(run_id AS VARCHAR), CAST(rows_written AS DOUBLE), NULL FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id LIMIT 200)
 UNION ALL SELECT 'fuel_types', NULL, fuel_code, fuel_name, CAST(is_renewable AS VARCHAR), NULL, NULL FROM fuels"""


@query(
    "export_set",
    "SNK5 PRJ14 JON2 AGG7",
    ctes("demand day_ahead generation interchange vintages fuels freshness runs dnow snow", EXPORT_SQL, **SPIKED_GRID, **SCAN),
)
def _(b):
    """All ten exports as CSV folders, real anomalies among them."""
    out = shared_dir(b.spark, "exports")
    demand = b.demand.withColumn("series", F.lit("D"))
    tables = reports.ExportTables(demand, b.day_ahead, b.generation, b.interchange, _scan(b), b.vintages, b.freshness, b.runs, b.fuels, b.nations)
    schemas = reports.write_exports(tables, out)
    parts = []
    for name, columns in COLUMNS.items():
        df = b.spark.read.option("header", "true").schema(schemas[name]).csv(f"{out}/{name}")
        kinds = ("timestamp_ntz", "string", "string", "string", "double", "double")
        cells = [(F.col(c) if c else F.lit(None)).cast(kind).alias(n) for c, n, kind in zip(columns, "tklmab", kinds, strict=True)]
        parts.append(df.select(F.lit(name).alias("name"), *cells))
    return rounded(reduce(DataFrame.unionByName, parts))
