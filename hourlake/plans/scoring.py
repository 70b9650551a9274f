"""Scoring runs that store their result: forecast vintages, anomalies and mix shifts.

Each run can be repeated: rows are upserted by the table's key, so the same run again changes nothing
and a later one adds to the table or replaces what it scored anew.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from hourlake import schemas
from hourlake.functions.times import anchor, time_literal
from hourlake.operators import forecast, upkeep


def store_forecast(demand: DataFrame, path: str, as_of=None, fit_at=None, order_col: str | None = None, horizon: int = 24) -> DataFrame:
    """Add a forecast vintage to the table. Returns keys per model of this run, ``none`` for keys without a forecast.

    ``order_col`` decides which of several rows of an hour is the last, and so counts.
    """
    stamp = _value(demand, fit_at if fit_at is not None else as_of)
    vintage = forecast.demand_forecast(demand, as_of, stamp, horizon, order_col=order_col)
    upkeep.upsert(vintage, path, schemas.TABLE_KEYS["ml.demand_forecast"], grain="month")
    spark = demand.sparkSession
    stored = spark.read.parquet(path) if upkeep.exists(spark, path) else vintage
    report = forecast.model_report(demand, stored.where(F.col("fit_at_utc") == time_literal(stamp, stored.schema["fit_at_utc"].dataType)), as_of)
    return spark.createDataFrame(report.collect(), report.schema)  # a row per model, read before a later run swaps files


def _value(df: DataFrame, as_of) -> dt.datetime:
    """The reference time as a value, computed once for the whole run."""
    return df.sparkSession.range(1).select(anchor(df, "period_utc", as_of)).first()[0]


def store_anomalies(demand: DataFrame, path: str, as_of=None, detected_at=None, order_col: str | None = None) -> int:
    """Score each key's last hours and upsert them by (period, key) with the time of the run. Returns the rows."""
    scored = forecast.anomaly_scan(demand, as_of, order_col=order_col)
    stamp = time_literal(_value(demand, detected_at if detected_at is not None else as_of), demand.schema["period_utc"].dataType)
    return upkeep.upsert(scored.withColumn("detected_at", stamp), path, schemas.TABLE_KEYS["ml.demand_anomaly"], grain="month")


def store_mix_shift(generation: DataFrame, path: str, as_of=None, detected_at=None, **limits) -> int:
    """Add the shifts of this run under the time of the run. Returns the rows."""
    stamp = time_literal(_value(generation, detected_at if detected_at is not None else as_of), generation.schema["period_utc"].dataType)
    shifts = forecast.mix_shift(generation, as_of, **limits).withColumn("detected_at_utc", stamp)
    return upkeep.upsert(shifts, path, schemas.TABLE_KEYS["ml.generation_mix_shift"], time_col="detected_at_utc", grain="month")
