"""Regular hourly grid, forecasts, anomaly scores, accuracy and mix shift.

All keys are handled in one plan. The per-key windows here run on at most ``days * 24`` grid rows a
key: the history filter bounds them, so a plain ``partitionBy(key)`` is safe whatever the number of
rows per key before it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hourlake.functions.labels import severity
from hourlake.functions.numbers import pct
from hourlake.functions.times import anchor, interval_hours, seconds_between, time_literal
from hourlake.operators.filters import only_key, prune_dates, trailing
from hourlake.operators.joins import forecast_timeline, pair_actuals
from hourlake.operators.rollups import score_sets
from hourlake.operators.windows import latest_vintage

HISTORY_DAYS = 14
MIN_ROWS = 72
ROLL_ROWS = 168
ROLL_MIN = 24
DAY = 24

# --- fixed values: interval multipliers and model names -----------------------------------------
NAIVE_Z = 1.28
AR_Z = 1.2816
NAIVE_MODEL = "seasonal-naive-24h"
AR_MODEL = "seasonal-ar1-24h"
# --- end of fixed values -------------------------------------------------------------------------


def _by_key(key: str) -> W:
    return W.partitionBy(key).orderBy("period_utc")


def _upto(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, 0)


def _onward(w: W) -> W:
    return w.rowsBetween(0, W.unboundedFollowing)


# --- grid -------------------------------------------------------------------------------------


def history(demand: DataFrame, as_of=None, days: int = HISTORY_DAYS) -> DataFrame:
    """The fitting window; nothing beyond it reaches the windows below."""
    return trailing(demand, "period_utc", days * 24, as_of, max_hours=days * 24)


def grid_report(demand: DataFrame, key: str = "ba_code", min_rows: int = MIN_ROWS) -> DataFrame:
    """What the grid makes of each key's rows: n_rows with a value, off_grid rows that lie between its hours
    and are left out, repeated rows of an hour of which one counts, and whether the key is used at all.

    Sum finer input to hours before the fit; a grid takes full hours from the key's first time on.
    """
    known = demand.where(F.col("value_mwh").isNotNull())
    firsts = known.groupBy(key).agg(F.min("period_utc").alias("_first"))
    hourly = known.groupBy(key, "period_utc").agg(F.count(F.lit(1)).alias("_n")).join(firsts, key)
    off = seconds_between("_first", "period_utc") % 3600 != 0
    out = hourly.groupBy(key).agg(
        F.sum("_n").alias("n_rows"), F.sum(F.when(off, F.col("_n")).otherwise(0)).alias("off_grid"), F.sum(F.when(~off, F.col("_n") - 1).otherwise(0)).alias("repeated")
    )
    return out.withColumn("used", F.col("n_rows") >= min_rows)


def regular_grid(demand: DataFrame, key: str = "ba_code", min_rows: int = MIN_ROWS, order_col: str | None = None) -> DataFrame:
    """Every hour between a key's first and last value, gaps interpolated.

    Nulls are dropped, keys with too few rows skipped (counted before duplicates go), and of several
    rows for one hour the last by ``order_col`` stays (the largest value without one). Expects the
    history window as input.
    """
    known = demand.where(F.col("value_mwh").isNotNull())
    last = F.max_by("value_mwh", order_col) if order_col else F.max("value_mwh")
    hourly = known.groupBy(key, "period_utc").agg(last.alias("value_mwh"), F.count(F.lit(1)).alias("_n"))
    spans = hourly.groupBy(key).agg(
        F.sum("_n").alias("_rows"), F.min("period_utc").alias("_first"), F.max("period_utc").alias("_last")
    )
    grid = spans.where(F.col("_rows") >= min_rows).select(
        key, F.explode(F.sequence("_first", "_last", F.expr("INTERVAL '1' HOUR"))).alias("period_utc")
    )
    joined = grid.join(hourly.drop("_n"), [key, "period_utc"], "left")
    w = _by_key(key)
    at = F.when(F.col("value_mwh").isNotNull(), F.col("_i"))
    v0, v1 = F.last("value_mwh", True).over(_upto(w)), F.first("value_mwh", True).over(_onward(w))
    i0, i1 = F.last(at, True).over(_upto(w)), F.first(at, True).over(_onward(w))
    line = v0 + (v1 - v0) * (F.col("_i") - i0) / F.nullif(i1 - i0, F.lit(0))
    numbered = joined.withColumn("_i", F.row_number().over(w))
    return numbered.withColumn("value_mwh", F.coalesce(F.col("value_mwh"), line)).select(key, "period_utc", "value_mwh")


# --- anomaly scan -----------------------------------------------------------------------------


def anomaly_scan(demand: DataFrame, as_of=None, key: str = "ba_code", score_hours: int = DAY, order_col: str | None = None) -> DataFrame:
    """Scores of each key's last ``score_hours`` hours.

    Expected demand is the mean of the 168 hours before, shaped by the key's mean profile over the
    day. The residual is put against the rolling deviation of the residuals.
    """
    grid = regular_grid(history(demand, as_of), key, order_col=order_col)
    w = _by_key(key)
    hour = F.hour("period_utc")
    per_hour = W.partitionBy(key, "_hour")
    first_of_hour = F.row_number().over(per_hour.orderBy("period_utc")) == 1
    profiled = (
        grid.withColumn("_hour", hour)
        .withColumns({"_profile": F.avg("value_mwh").over(per_hour), "_first": first_of_hour})
        .withColumn("_level", F.avg(F.when(F.col("_first"), F.col("_profile"))).over(W.partitionBy(key)))
    )
    before = w.rowsBetween(-ROLL_ROWS, -1)
    base = F.when(F.count("value_mwh").over(before) >= ROLL_MIN, F.avg("value_mwh").over(before))
    shaped = profiled.withColumn("_raw", base * F.col("_profile") / F.col("_level"))
    expected = F.coalesce(F.first("_raw", True).over(_onward(w)), F.last("_raw", True).over(_upto(w)))
    residual = shaped.withColumn("expected_mwh", expected).withColumn(
        "residual_mwh", F.col("value_mwh") - F.col("expected_mwh")
    )
    recent = w.rowsBetween(-(ROLL_ROWS - 1), 0)
    spread = F.when(
        F.count("residual_mwh").over(recent) >= ROLL_MIN, F.nullif(F.stddev_samp("residual_mwh").over(recent), F.lit(0.0))
    )
    spread_filled = F.coalesce(F.first("_sd", True).over(_onward(w)), F.last("_sd", True).over(_upto(w)))
    back = F.row_number().over(W.partitionBy(key).orderBy(F.col("period_utc").desc()))
    scored = (
        residual.withColumn("_sd", spread)
        .withColumns({"_spread": spread_filled, "_back": back})
        .where(F.col("_back") <= score_hours)
        .withColumn("z_score", F.coalesce(F.col("residual_mwh") / F.col("_spread"), F.lit(0.0)))
    )
    return scored.select(
        "period_utc",
        key,
        F.col("value_mwh").alias("actual_mwh"),
        "expected_mwh",
        "residual_mwh",
        "z_score",
        (F.abs("z_score") >= 2.0).alias("is_anomaly"),
        severity("z_score").alias("severity"),
    )


# --- forecasts --------------------------------------------------------------------------------


def _steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(horizon)))


def _ahead(last: str, step: str = "step") -> Column:
    return F.col(last) + F.make_dt_interval(hours=F.col(step))


def seasonal_naive(demand: DataFrame, as_of=None, horizon: int = 24, key: str = "ba_code") -> DataFrame:
    """The last 24 values repeated over the horizon, with a band from the last week's deviation."""
    return _naive(regular_grid(history(demand, as_of), key), horizon, key)


def _naive(grid: DataFrame, horizon: int, key: str) -> DataFrame:
    back = F.row_number().over(W.partitionBy(key).orderBy(F.col("period_utc").desc()))
    tail = grid.withColumn("_back", back).where(F.col("_back") <= ROLL_ROWS)
    level = tail.groupBy(key).agg(
        F.max("period_utc").alias("_last"),
        F.coalesce(F.nullif(F.stddev_pop("value_mwh"), F.lit(0.0)), F.lit(1.0)).alias("_sd"),
    )
    pattern = tail.where(F.col("_back") <= DAY).select(key, (DAY - F.col("_back")).alias("_slot"), F.col("value_mwh").alias("yhat_mwh"))
    steps = level.withColumn("step", _steps(horizon)).withColumn("_slot", (F.col("step") - 1) % DAY)
    half = NAIVE_Z * F.col("_sd")
    return steps.join(pattern, [key, "_slot"]).select(
        _ahead("_last").alias("period_utc"),
        key,
        "yhat_mwh",
        (F.col("yhat_mwh") - half).alias("yhat_lower"),
        (F.col("yhat_mwh") + half).alias("yhat_upper"),
        F.lit(NAIVE_MODEL).alias("model_name"),
    )


def seasonal_ar1(demand: DataFrame, as_of=None, horizon: int = 24, key: str = "ba_code") -> DataFrame:
    """Hour-of-day means with first-order autoregressive residuals, fitted in closed form.

    The band holds 80 % of outcomes under normal errors. Keys whose residuals do not vary have no
    fit and are left out.
    """
    return _ar1(regular_grid(history(demand, as_of), key), horizon, key)


def _ar1(grid: DataFrame, horizon: int, key: str) -> DataFrame:
    timed = grid.withColumn("_hour", F.hour("period_utc"))
    resid = timed.withColumn("_mean", F.avg("value_mwh").over(W.partitionBy(key, "_hour"))).withColumn(
        "_u", F.col("value_mwh") - F.col("_mean")
    )
    lagged = resid.withColumn("_u1", F.lag("_u", 1).over(_by_key(key)))
    u, u1 = F.col("_u"), F.when(F.col("_u1").isNotNull(), F.col("_u"))
    fit = lagged.groupBy(key).agg(
        F.regr_slope("_u", "_u1").alias("_slope"),
        F.var_samp(u1).alias("_vu"),
        F.covar_samp("_u", "_u1").alias("_cov"),
        F.var_samp("_u1").alias("_v1"),
        F.max("period_utc").alias("_last"),
        F.max_by(u, "period_utc").alias("_u_last"),
    )
    phi = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("_slope")))
    # variance of u - phi * u1 over the pairs, from their second moments
    innovation = F.col("_vu") - 2 * F.col("phi") * F.col("_cov") + F.col("phi") * F.col("phi") * F.col("_v1")
    fitted = (
        fit.where(F.col("_slope").isNotNull())
        .withColumn("phi", phi)
        .withColumn("_sigma", F.sqrt(F.greatest(innovation, F.lit(0.0))))
    )
    profile = resid.groupBy(key, "_hour").agg(F.first("_mean").alias("_mean"))
    steps = fitted.withColumn("step", _steps(horizon)).withColumn("_hour", (F.hour("_last") + F.col("step")) % DAY)
    decay = F.pow(F.col("phi"), F.col("step"))
    width = AR_Z * F.col("_sigma") * F.sqrt((1 - F.pow(F.col("phi"), 2 * F.col("step"))) / (1 - F.col("phi") * F.col("phi")))
    yhat = F.col("_mean") + decay * F.col("_u_last")
    return steps.join(profile, [key, "_hour"]).select(
        _ahead("_last").alias("period_utc"),
        key,
        yhat.alias("yhat_mwh"),
        (yhat - width).alias("yhat_lower"),
        (yhat + width).alias("yhat_upper"),
        F.lit(AR_MODEL).alias("model_name"),
    )


def demand_forecast(demand: DataFrame, as_of=None, fit_at=None, horizon: int = 24, key: str = "ba_code", order_col: str | None = None) -> DataFrame:
    """One forecast vintage: the fitted model where there is one, the seasonal pattern elsewhere.

    ``fit_at_utc`` is part of the key, so a later run adds rows and overwrites none.
    """
    grid = regular_grid(history(demand, as_of), key, order_col=order_col)
    model = _ar1(grid, horizon, key)
    fallback = _naive(grid, horizon, key).join(model.select(key).distinct(), key, "left_anti")
    stamp = anchor(demand, "period_utc", fit_at if fit_at is not None else as_of)
    return model.unionByName(fallback).withColumn("fit_at_utc", stamp)


def model_report(demand: DataFrame, forecast: DataFrame, as_of=None, key: str = "ba_code") -> DataFrame:
    """Keys per outcome of a run: each model used, and ``none`` for keys that got no forecast."""
    seen = history(demand, as_of).select(key).distinct()
    used = forecast.select(key, "model_name").distinct()
    outcome = seen.join(used, key, "left").withColumn("model_name", F.coalesce("model_name", F.lit("none")))
    return outcome.groupBy("model_name").agg(F.count(F.lit(1)).alias("keys"))


def forecast_with(demand: DataFrame, fit, as_of=None, horizon: int = 24, key: str = "ba_code", model_name: str = "custom") -> DataFrame:
    """A forecaster of the caller's own, run per key on Spark.

    ``fit(values, horizon)`` gets a key's grid values in time order (at most the history window)
    and returns the point, lower and upper forecasts as three sequences.
    """
    grid = regular_grid(history(demand, as_of), key)
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}

    def one_key(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period_utc")
        yhat, lower, upper = fit(pdf["value_mwh"].to_numpy(), horizon)
        ahead = [pdf["period_utc"].iloc[-1] + pd.Timedelta(hours=i) for i in range(1, horizon + 1)]
        return pd.DataFrame(
            {"period_utc": ahead, key: pdf[key].iloc[0], "yhat_mwh": yhat, "yhat_lower": lower, "yhat_upper": upper, "model_name": model_name}
        )

    out = (
        f"period_utc {kinds['period_utc']}, {key} {kinds[key]}, yhat_mwh double, yhat_lower double, "
        "yhat_upper double, model_name string"
    )
    return grid.groupBy(key).applyInPandas(one_key, out)


# --- accuracy ---------------------------------------------------------------------------------


def forecast_accuracy(
    vintages: DataFrame,
    day_ahead: DataFrame,
    demand: DataFrame,
    as_of=None,
    hours: int = 168,
    ba_code: str | None = None,
    names: tuple[str, str] = ("model", "day_ahead"),
) -> DataFrame:
    """Both forecast sources against realised demand, overall and per key.

    The model is scored on its latest vintage per hour. Both sources go through one join and one
    aggregation, told apart by ``source``.
    """
    keys = ["ba_code", "period_utc"]
    end = anchor(demand, "period_utc", as_of)
    model = trailing(only_key(vintages, "ba_code", ba_code), "period_utc", hours, end, upper=True, max_hours=720)
    feed = trailing(only_key(day_ahead, "ba_code", ba_code), "period_utc", hours, end, upper=True, max_hours=720)
    latest = latest_vintage(model, keys).select(*keys, F.col("yhat_mwh").alias("yhat"), F.lit(names[0]).alias("source"))
    both = latest.unionByName(feed.select(*keys, F.col("value_mwh").alias("yhat"), F.lit(names[1]).alias("source")))
    actual = trailing(demand, "period_utc", hours, end, upper=True, max_hours=720)
    pairs = pair_actuals(both, actual, keys)
    sources = demand.sparkSession.createDataFrame([(n,) for n in names], "source string")
    return score_sets(pairs, groups=sources)


def _fresh(vintages: DataFrame, end: Column, fit_hours: int) -> DataFrame:
    """Vintages of a recent fit. A vintage begins after the data it was fitted on, which is at most
    the history window older than the fit, so the partitions of earlier periods are not opened."""
    start = end - interval_hours(fit_hours)
    return prune_dates(vintages, "period_utc", start - interval_hours(HISTORY_DAYS * 24)).where(F.col("fit_at_utc") > start)


def forecast_view(
    demand: DataFrame, vintages: DataFrame, as_of=None, ba_code: str | None = None, actual_hours: int = 72, fit_hours: int = 6
) -> DataFrame:
    """Recent actuals and the latest vintage of a recent fit, merged on one timeline per key."""
    end = anchor(demand, "period_utc", as_of)
    actual = trailing(only_key(demand, "ba_code", ba_code), "period_utc", actual_hours, end)
    fresh = _fresh(only_key(vintages, "ba_code", ba_code), end, fit_hours)
    return forecast_timeline(actual, latest_vintage(fresh, ["ba_code", "period_utc"]))


def forecast_facts(demand: DataFrame, vintages: DataFrame, as_of=None, actual_hours: int = 72, fit_hours: int = 6) -> DataFrame:
    """Per key the last actual, the first and the peak forecast, and the number of forecast hours."""
    end = anchor(demand, "period_utc", as_of)
    actual = trailing(demand, "period_utc", actual_hours, end).where(F.col("value_mwh").isNotNull())
    fresh = _fresh(vintages, end, fit_hours)
    latest = latest_vintage(fresh, ["ba_code", "period_utc"]).where(F.col("yhat_mwh").isNotNull())
    left = actual.groupBy("ba_code").agg(
        F.max("period_utc").alias("last_actual_utc"), F.max_by("value_mwh", "period_utc").alias("last_actual_mwh")
    )
    epoch = time_literal("1970-01-01 00:00:00", vintages.schema["period_utc"].dataType)
    earliest = seconds_between("period_utc", epoch)  # of equal peaks the first one counts
    right = latest.groupBy("ba_code").agg(
        F.min("period_utc").alias("first_forecast_utc"),
        F.min_by("yhat_mwh", "period_utc").alias("first_yhat_mwh"),
        F.max("yhat_mwh").alias("peak_yhat_mwh"),
        F.max_by("period_utc", F.struct("yhat_mwh", earliest)).alias("peak_utc"),
        F.count(F.lit(1)).alias("horizon_hours"),
    )
    return left.join(right, "ba_code", "full_outer").withColumn("horizon_hours", F.coalesce("horizon_hours", F.lit(0)))


# --- mix shift --------------------------------------------------------------------------------


def mix_shift(
    generation: DataFrame, as_of=None, now_hours: int = 24, base_days: int = HISTORY_DAYS, warn_pp: float = 5.0, crit_pp: float = 10.0
) -> DataFrame:
    """Each fuel's share of its key's generation lately against the days before, in points."""
    end = anchor(generation, "period_utc", as_of)
    total_h = now_hours + base_days * 24
    rows = trailing(generation, "period_utc", total_h, end, upper=True, max_hours=total_h)
    is_now = F.col("period_utc") > end - interval_hours(now_hours)
    v = F.col("value_mwh")
    by_fuel = rows.groupBy("ba_code", "fuel_code").agg(
        F.sum(F.when(is_now, v).otherwise(0.0)).alias("_now"), F.sum(F.when(~is_now, v).otherwise(0.0)).alias("_base")
    )
    totals = by_fuel.groupBy("ba_code").agg(F.sum("_now").alias("_now_all"), F.sum("_base").alias("_base_all"))
    shares = by_fuel.join(totals, "ba_code").withColumns(
        {"share_now": pct("_now", "_now_all"), "share_baseline": pct("_base", "_base_all")}
    )
    shift = F.col("share_now") - F.col("share_baseline")
    return shares.select(
        "ba_code", "fuel_code", "share_now", "share_baseline", shift.alias("shift_pp"), severity(shift, warn_pp, crit_pp).alias("severity")
    )
