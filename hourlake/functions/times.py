"""Time columns: buckets, window anchors, ages and period parsing.

All of them keep the type they are given. Zone-less timestamps (TIMESTAMP_NTZ) are never passed
through ``date_trunc`` or ``unix_timestamp``, which would read them in the session zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket_start(time_col: str | Column, width: str) -> Column:
    """Start of the tumbling bucket a timestamp falls in, for example ``'1 hour'`` or ``'1 day'``."""
    return F.window(time_col, width)["start"]


def interval_hours(hours: int) -> Column:
    return F.expr(f"INTERVAL '{int(hours)}' HOUR")


def anchor(df: DataFrame, time_col: str, as_of=None) -> Column:
    """The reference time of a trailing window.

    ``as_of`` may be a Column (for example a scalar subquery), a datetime or an ISO string. Without
    one the latest time in ``df`` is used, as a scalar subquery: one partial aggregate whose single
    value Spark hands to the filter, so no join and no driver round trip.
    """
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return df.agg(F.max(time_col)).scalar()
    target = df.schema[time_col].dataType
    return time_literal(as_of, target)


def time_literal(value, target: T.DataType) -> Column:
    """A literal of the column's own timestamp type; datetimes with a zone are converted to UTC."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    if isinstance(target, T.TimestampType):
        value = f"{value}Z"
    return F.lit(value).cast(target)


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Seconds from ``start`` to ``end``, computed on the difference itself, free of any zone."""
    return (col(end) - col(start)).cast("interval second").cast("decimal(20,6)").cast("double")


def parse_utc(c: str | Column) -> Column:
    """ISO timestamp text, blank or T between date and time, down to hours, minutes or seconds; a trailing
    zone or offset is honoured, text without one is UTC. What cannot be read is null.

    The cast takes a zone after seconds only, so they are filled in; texts without a zone need no pattern.
    """
    text = F.trim(col(c))
    n = F.length(text)
    zoned = F.regexp_replace(F.regexp_replace(text, "^(.{13})(?=[zZ+-])", "$1:00"), "^(.{16})(?=[zZ+-])", "$1:00")
    whole = (
        F.when(n < 13, None)
        .when(n == 13, F.concat(text, F.lit(":00:00Z")))
        .when(F.substring(text, 14, 40).rlike("[zZ+-]"), F.upper(zoned))
        .when(n == 16, F.concat(text, F.lit(":00Z")))
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return F.try_to_timestamp(whole)


def parse_period(c: str | Column) -> Column:
    """``YYYY-MM-DDTHH`` or an ISO timestamp, read as UTC unless it names a zone."""
    return parse_utc(c)


def resolution_minutes(c: str | Column) -> Column:
    """Minutes in an ISO duration of the forms PTnM and PTnH; anything else counts as one hour."""
    text = F.upper(col(c))
    number = F.regexp_extract(text, "^PT(\\d+)[MH]$", 1).try_cast("bigint")
    return (
        F.when(text.rlike("^PT\\d+M$"), number)
        .when(text.rlike("^PT\\d+H$"), number * 60)
        .otherwise(F.lit(60))
        .try_cast("int")
    )
