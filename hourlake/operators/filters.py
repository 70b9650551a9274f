"""Projections and filters.

Window bounds are strict at the start (``time > as_of - hours``). Filters on the raw time column
stand before any aggregation, so they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hourlake.functions.times import anchor, interval_hours, seconds_between

DATE_COL, MONTH_COL = "d", "m"


def series_rows(demand: DataFrame, series: str = "D", new_name: str = "demand_mwh") -> DataFrame:
    """One series of the long demand table with its value renamed."""
    return demand.where(F.col("series") == series).select(
        "period_utc", "ba_code", F.col("value_mwh").alias(new_name), "source"
    )


def rename_value(df: DataFrame, value_col: str, new_name: str) -> DataFrame:
    return df.withColumnRenamed(value_col, new_name)


def check_hours(hours: int, max_hours: int) -> int:
    if not 1 <= int(hours) <= max_hours:
        raise ValueError(f"hours must be within 1..{max_hours}, got {hours}")
    return int(hours)


def prune_dates(df: DataFrame, time_col: str, start: Column, end: Column | None = None) -> DataFrame:
    """The bounds of a time window on the day or month partition of a stored fact table, if ``df`` has one.

    The anchor is a literal or a scalar subquery, so the folders to open are chosen when it is known,
    before any file is read. Facts are partitioned by the day or month of ``period_utc``.
    """
    if time_col != "period_utc":
        return df
    for name, low in ((DATE_COL, F.to_date), (MONTH_COL, lambda t: F.trunc(t, "month"))):
        if name in df.columns and isinstance(df.schema[name].dataType, T.DateType):
            df = df.where(F.col(name) >= low(start))
            df = df if end is None else df.where(F.col(name) <= low(end))
    return df


def trailing(
    df: DataFrame,
    time_col: str,
    hours: int,
    as_of=None,
    upper: bool = False,
    max_hours: int = 168,
) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``; with ``upper`` none after it."""
    check_hours(hours, max_hours)
    end = anchor(df, time_col, as_of)
    start = end - interval_hours(hours)
    out = prune_dates(df, time_col, start, end if upper else None).where(F.col(time_col) > start)
    return out.where(F.col(time_col) <= end) if upper else out


def trailing_latest(
    df: DataFrame,
    time_col: str,
    hours: int,
    key_col: str | None = None,
    key: str | None = None,
    max_hours: int = 168,
    as_of=None,
) -> DataFrame:
    """Rows of the last ``hours`` available, counted from ``as_of`` or else the latest time in the data.

    With ``key`` only that key's rows, counted from its own latest time.
    """
    rows = only_key(df, key_col, key) if key_col else df
    return trailing(rows, time_col, hours, as_of, max_hours=max_hours)


def trailing_per_key(df: DataFrame, time_col: str, hours: int, key_col: str, as_of=None, keys: DataFrame | None = None, first_hours: int = 168) -> DataFrame:
    """Each key's last ``hours``, counted from that key's own latest time (up to ``as_of``).

    The per-key maxima are a small aggregate; joining them lets Spark broadcast it when it is small
    and split hot keys otherwise. With ``as_of`` the last ``first_hours`` are read first, pruned by day; the
    older rows are looked at for keys without any there. ``keys`` names all keys: if none of them is missing,
    the older rows are not read at all.
    """
    t = F.col(time_col)

    def last_hours(rows: DataFrame, latest: DataFrame) -> DataFrame:
        return rows.join(latest, key_col).where(t > F.col("_latest") - interval_hours(hours)).drop("_latest")

    newest = F.max(time_col).alias("_latest")
    if as_of is None:
        return last_hours(df, df.groupBy(key_col).agg(newest))
    end = anchor(df, time_col, as_of)
    cut = end - interval_hours(first_hours)
    found = prune_dates(df, time_col, cut, end).where((t > cut) & (t <= end)).groupBy(key_col).agg(newest)
    low = cut - interval_hours(hours)
    near = last_hours(prune_dates(df, time_col, low, end).where((t > low) & (t <= end)), found)
    older = df.where(t <= cut)
    missing = (keys if keys is not None else older).select(key_col).distinct().join(found, key_col, "left_anti")
    far = older.join(missing, key_col, "left_semi")
    return near.unionByName(last_hours(far, far.groupBy(key_col).agg(newest)))


def settled(df: DataFrame, time_col: str, as_of=None, from_h: int = 72, to_h: int = 3) -> DataFrame:
    """Hours old enough to be final: ``as_of - from_h < time <= as_of - to_h``."""
    end = anchor(df, time_col, as_of)
    start, stop = end - interval_hours(from_h), end - interval_hours(to_h)
    t = F.col(time_col)
    return prune_dates(df, time_col, start, stop).where((t > start) & (t <= stop))


def only_key(df: DataFrame, key_col: str, key: str | None = None) -> DataFrame:
    return df if key is None else df.where(F.col(key_col) == key)


def active_keys(df: DataFrame, key_col: str, time_col: str, as_of=None, days: int = 7) -> DataFrame:
    recent = trailing(df, time_col, days * 24, as_of)
    return recent.select(key_col).distinct().orderBy(key_col)


def demand_latest(demand: DataFrame, hours: int = 24, as_of=None) -> DataFrame:
    rows = trailing(demand, "period_utc", hours, as_of)
    return rows.select("period_utc", "ba_code", "value_mwh").orderBy("period_utc", "ba_code")


def anomalies_recent(anomalies: DataFrame, hours: int = 48, as_of=None) -> DataFrame:
    """Flagged rows of the window, strongest first."""
    rows = trailing(anomalies, "period_utc", hours, as_of).where("is_anomaly")
    return rows.select(
        "period_utc", "ba_code", "actual_mwh", "expected_mwh", "residual_mwh", "z_score", "severity"
    ).orderBy(F.abs("z_score").desc(), F.col("period_utc").desc(), "ba_code")


def with_ages(
    freshness: DataFrame,
    as_of: Column | None = None,
    unit: str = "seconds",
    fetch_col: str = "last_fetch_utc",
    period_col: str = "last_period_utc",
) -> DataFrame:
    """Age of the last fetch and of the last data hour, in seconds or minutes."""
    now = anchor(freshness, fetch_col, as_of)
    per, prefix = {"seconds": (1, "sec"), "minutes": (60, "minutes")}[unit]
    return freshness.withColumns(
        {
            f"{prefix}_since_fetch": seconds_between(fetch_col, now) / per,
            f"{prefix}_since_period": seconds_between(period_col, now) / per,
        }
    )
