"""Joins of facts with forecasts, dimensions and their own aggregates.

No join carries a broadcast hint. Fixed dimensions are local relations and limited frames have a
bounded size estimate, so the planner broadcasts them below its size threshold. Whatever grows past
it is a shuffle join, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourlake.functions.labels import strip_prefix, surrogate_key
from hourlake.functions.numbers import pct
from hourlake.functions.times import anchor, interval_hours
from hourlake.operators.filters import prune_dates, trailing


def demand_with_forecast(demand: DataFrame, forecast: DataFrame) -> DataFrame:
    """Demand and its forecast per (period, key). The error is 0 where there is no forecast.

    Both sides must be unique per key: resolve sources first when several feed one hour.
    """
    d = demand.select("period_utc", "ba_code", "demand_mwh")
    f = forecast.select("period_utc", "ba_code", "forecast_mwh")
    return d.join(f, ["period_utc", "ba_code"], "left").withColumn(
        "forecast_error_mwh", F.col("demand_mwh") - F.coalesce("forecast_mwh", "demand_mwh")
    )


def demand_vs_forecast_export(demand: DataFrame, forecast: DataFrame, as_of=None, hours: int = 336) -> DataFrame:
    """Export variant: the error is null without a forecast, the percentage needs a positive one."""
    d = trailing(demand, "period_utc", hours, as_of, max_hours=hours).select(
        "period_utc", "ba_code", F.col("value_mwh").alias("demand_mwh")
    )
    start = anchor(demand, "period_utc", as_of) - interval_hours(hours)
    f = prune_dates(forecast, "period_utc", start).where(F.col("period_utc") > start)
    f = f.select("period_utc", "ba_code", F.col("value_mwh").alias("forecast_mwh"))
    error = F.col("demand_mwh") - F.col("forecast_mwh")
    return d.join(f, ["period_utc", "ba_code"], "left").select(
        "period_utc",
        "ba_code",
        "demand_mwh",
        "forecast_mwh",
        error.alias("forecast_error_mwh"),
        pct(F.abs(error), "forecast_mwh").alias("abs_forecast_error_pct"),
    )


def generation_with_meta(generation: DataFrame, fuels: DataFrame, value_col: str = "value_mwh") -> DataFrame:
    """Generation with fuel name, category and flags; unlisted fuels get defaults."""
    return generation.join(fuels, "fuel_code", "left").select(
        "period_utc",
        "ba_code",
        "fuel_code",
        F.coalesce("fuel_name", "fuel_code").alias("fuel_name"),
        F.coalesce("category", F.lit("Other")).alias("fuel_category"),
        F.coalesce("is_renewable", F.lit(False)).alias("is_renewable"),
        F.coalesce("is_carbon_free", F.lit(False)).alias("is_carbon_free"),
        F.col(value_col).alias("generation_mwh"),
    )


def dim_keys(seen: DataFrame, meta: DataFrame, as_of=None, days: int = 90, time_col: str = "period_utc") -> DataFrame:
    """The keys seen lately with their attributes, defaults and a surrogate key."""
    hours = days * 24
    keys = trailing(seen, time_col, hours, as_of, max_hours=hours).select("ba_code").distinct()
    return keys.join(meta, "ba_code", "left").select(
        "ba_code",
        F.coalesce("ba_name", "ba_code").alias("ba_name"),
        F.coalesce("region", F.lit("Unknown")).alias("region"),
        F.coalesce("country", F.lit("US")).alias("country"),
        F.coalesce("timezone", F.lit("UTC")).alias("timezone"),
        surrogate_key("ba_code").alias("ba_sk"),
    )


def pair_actuals(
    forecast: DataFrame, actual: DataFrame, keys: list[str], yhat_col: str = "yhat", actual_col: str = "value_mwh"
) -> DataFrame:
    """Forecast hours that have been realised, both values present."""
    f = forecast.where(F.col(yhat_col).isNotNull())
    a = actual.where(F.col(actual_col).isNotNull()).select(*keys, F.col(actual_col).alias("actual"))
    return f.join(a, keys, "inner")


def align_hours(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two per-hour aggregates on the hours both have. Aggregate each side by ``keys`` beforehand:
    the join then reuses the partitioning of the two aggregations."""
    return left.join(right, keys, "inner")


def share_of_group(df: DataFrame, group: list[str], value_col: str, share_col: str = "share_pct") -> DataFrame:
    """Each row's percentage of its group total, null for totals of zero or less.

    The total is an aggregate joined back rather than a window, so that a hot group is summed by
    partial aggregation and never gathered in one task.
    """
    totals = df.groupBy(*group).agg(F.sum(value_col).alias("_total"))
    return df.join(totals, group).withColumn(share_col, pct(value_col, "_total")).drop("_total")


def with_location(latest: DataFrame, places: DataFrame, code_col: str, prefix: str) -> DataFrame:
    """Latest rows with the coordinates of their station; rows without a known one stay."""
    coded = latest.withColumn(code_col, strip_prefix("station_id", prefix))
    return coded.join(places.drop("station_id"), code_col, "left")


def forecast_timeline(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actuals and forecasts on one timeline per key.

    The last actual hour also seeds the forecast line where it has no forecast of its own. That hour
    is found by an aggregate of the actuals.
    """
    last = (
        actual.where(F.col("value_mwh").isNotNull()).groupBy("ba_code").agg(F.max("period_utc").alias("_boundary"))
    )
    a = actual.select("ba_code", "period_utc", F.col("value_mwh").alias("actual"))
    f = forecast.select(
        "ba_code",
        "period_utc",
        F.col("yhat_mwh").alias("yhat"),
        F.col("yhat_lower").alias("lower"),
        F.col("yhat_upper").alias("upper"),
    )
    at_boundary = F.col("period_utc") == F.col("_boundary")
    return (
        a.join(f, ["ba_code", "period_utc"], "full_outer")
        .join(last, "ba_code", "left")
        .withColumn("yhat", F.when(at_boundary, F.coalesce("yhat", "actual")).otherwise(F.col("yhat")))
        .drop("_boundary")
    )


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """The single value of a one-row, one-column frame on every row, as a scalar subquery."""
    return df.withColumn(name, one_row.scalar())


def scalar(df: DataFrame, value: Column) -> Column:
    """An aggregate over ``df`` as a scalar subquery."""
    return df.agg(value).scalar()
