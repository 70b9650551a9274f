"""Autoregressive and moving-average terms, seasonal ones too, by two least-squares regressions per key.

The first regression is a long autoregression; its residuals stand in for the innovations. The second one
regresses the value on its own lags and on lagged residuals. Both are solved from their normal equations,
of fixed size, for each key of a batch. A key brings at most its history window of hours, as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hourlake.operators.forecast import AR_Z, DAY, history, regular_grid

MODEL = "seasonal-arma-24h"
#: Lags of the first regression, and of values and residuals in the second.
LONG, LAGS = tuple(range(1, DAY + 2)), (1, DAY, DAY + 1)
#: Added to the diagonal of the normal equations, as a share of its mean.
RIDGE = 1e-8

FIT = "struct<coefficients: array<double>, sigma: double, yhat: array<double>, width: array<double>>"


def lagged(y: np.ndarray, lags: tuple[int, ...]) -> np.ndarray:
    """A column per lag; rows without all of them are left out."""
    first = max(lags)
    return np.column_stack([y[first - k : len(y) - k] for k in lags])


def solve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares from the normal equations."""
    gram = x.T @ x
    return np.linalg.solve(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)) + 1e-12 * np.eye(len(gram)), x.T @ y)


def fit(values: np.ndarray, horizon: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray] | None:
    """(coefficients of the lags and of the lagged residuals, sigma, forecasts, half widths of a unit band).

    None for a series too short for both regressions, without variation, or whose forecasts leave the
    range of its values by more than its width.
    """
    mean = values.mean()
    y = values - mean
    first, reach = max(LONG), max(LAGS)
    if len(y) < first + reach + 2 * len(LONG) or not np.ptp(y) > 1e-9 * max(abs(mean), 1.0):
        return None
    x = lagged(y, LONG)
    e = np.concatenate([np.zeros(first), y[first:] - x @ solve(x, y[first:])])
    start = first + reach
    both = np.column_stack([lagged(y, LAGS), lagged(e, LAGS)])[start - reach :]
    c = solve(both, y[start:])
    p = len(LAGS)
    residuals = y[start:] - both @ c
    sigma = float(np.sqrt(residuals @ residuals / max(len(residuals) - len(c), 1)))
    e = np.concatenate([e[:start], residuals])
    ys, es = list(y[-reach:]), list(e[-reach:])
    psi = [1.0]
    for h in range(1, horizon + 1):
        ys.append(sum(c[i] * ys[-k] + c[p + i] * es[-k] for i, k in enumerate(LAGS)))
        es.append(0.0)
        psi.append(sum((c[i] * psi[h - k] if h >= k else 0.0) + (c[p + i] if h == k else 0.0) for i, k in enumerate(LAGS)))
    yhat = np.array(ys[reach:]) + mean
    spread = np.ptp(values)
    if not np.isfinite(yhat).all() or yhat.max() > values.max() + spread or yhat.min() < values.min() - spread:
        return None
    return c, sigma, yhat, sigma * np.sqrt(np.cumsum(np.square(psi[:horizon])))


def fitted(grid: DataFrame, horizon: int, key: str) -> DataFrame:
    """Per key that has a fit: key, _last and the fields of ``FIT``."""

    @F.pandas_udf(FIT)
    def fits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch:
                found = fit(np.asarray(values, float), horizon)
                rows.append((None,) * 4 if found is None else (found[0].tolist(), found[1], found[2].tolist(), found[3].tolist()))
            yield pd.DataFrame(rows, columns=["coefficients", "sigma", "yhat", "width"])

    series = grid.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("period_utc", "value_mwh"))), lambda r: r["value_mwh"]).alias("_values"), F.max("period_utc").alias("_last")
    )
    return series.select(key, "_last", fits("_values").alias("_fit")).where("_fit.yhat IS NOT NULL").select(key, "_last", "_fit.*")


def seasonal_arma(demand: DataFrame, as_of=None, horizon: int = DAY, key: str = "ba_code") -> DataFrame:
    """Forecasts of every key that has a fit, in the columns of ``forecast.seasonal_ar1``.

    The band holds 80 % of outcomes under normal errors. Keys without a fit are left out.
    """
    return of_grid(regular_grid(history(demand, as_of), key), horizon, key)


def of_grid(grid: DataFrame, horizon: int, key: str) -> DataFrame:
    steps = fitted(grid, horizon, key).select(key, "_last", F.posexplode(F.arrays_zip("yhat", "width")).alias("_at", "_s"))
    half = AR_Z * F.col("_s.width")
    return steps.select(
        (F.col("_last") + F.make_dt_interval(hours=F.col("_at") + 1)).alias("period_utc"),
        key,
        F.col("_s.yhat").alias("yhat_mwh"),
        (F.col("_s.yhat") - half).alias("yhat_lower"),
        (F.col("_s.yhat") + half).alias("yhat_upper"),
        F.lit(MODEL).alias("model_name"),
    )


def arma_forecast(demand: DataFrame, as_of=None, horizon: int = DAY, key: str = "ba_code", order_col: str | None = None) -> DataFrame:
    """Forecasts of every key: this model where it has a fit, else the first-order one, else the seasonal pattern."""
    from hourlake.operators import forecast

    grid = regular_grid(history(demand, as_of), key, order_col=order_col)
    out = of_grid(grid, horizon, key)
    for other in (forecast._ar1, forecast._naive):
        rest = other(grid, horizon, key).join(out.select(key).distinct(), key, "left_anti")
        out = out.unionByName(rest)
    return out
